"""Tokens, coverage, chunks and search over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as T
from ..registry import query
from ..sources.tables import table

_RE = r"[\p{L}\p{N}_''-]+"


def _tok(table_: str, i: str, t: str = "text") -> str:
    return f"SELECT {i}, unnest(regexp_extract_all(lower({t}), '{_RE}')) AS token FROM {table_}"


@query(f"SELECT row_number() OVER (ORDER BY n DESC, token) AS rank, token, n FROM (SELECT token, count(*) AS n FROM ({_tok('documents', 'doc_id')}) GROUP BY 1 ORDER BY n DESC, token LIMIT 1000)")
def token_frequencies(spark, sf_dir):
    return T.token_frequencies(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""
WITH r AS (SELECT text AS t, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents UNION ALL SELECT * FROM (VALUES (NULL, NULL), ('', ''), (' ' || chr(10), ''), ('?!', '?!'))), d AS (SELECT t, CASE WHEN h <> '' THEN t END AS v, CASE WHEN h <> '' THEN h END AS h, CASE WHEN h <> '' THEN regexp_extract_all(lower(t), '{_RE}') END AS k FROM r), v AS (SELECT token, count(*) AS n FROM (SELECT unnest(k) AS token FROM d) GROUP BY token), s AS (SELECT sum(n) AS n FROM v)
SELECT count(*) AS n_docs, count(*) FILTER (t IS NULL) AS n_nan, count(*) FILTER (t IS NOT NULL AND v IS NULL) AS n_empty_string, count(*) FILTER (len(k) = 0) AS n_empty_after_tokenization, round(1 - count(DISTINCT h) * 1.0 / count(h), 4) AS duplicate_rate_normalized, median(length(v)) AS chars_median, quantile_cont(length(v), 0.95) AS chars_p95, median(len(k)) AS tokens_median, quantile_cont(len(k), 0.95) AS tokens_p95,
 (SELECT count(*) FROM v) AS vocab_size, (SELECT round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0 END), 4) FROM v) AS hapax_share, (SELECT round(sum(n) / (SELECT n FROM s), 4) FROM (SELECT n FROM v ORDER BY n DESC LIMIT 10)) AS top10_token_share, (SELECT round(coalesce(sum(n) FILTER (NOT regexp_matches(token, '\\p{{L}}')), 0) / (SELECT n FROM s), 4) FROM v) AS non_alpha_token_share FROM d
""")
def text_summary(spark, sf_dir):
    odd = spark.createDataFrame([(None,), ("",), (" \n",), ("?!",)], "text string")
    return T.text_summary(table(spark, sf_dir, "documents").select("text").unionByName(odd), "text")


@query(f"""
WITH v AS (SELECT DISTINCT token FROM ({_tok('benchmark', 'item_id')})), n AS (SELECT doc_id, t.token, count(*) AS n, v.token IS NULL AS o FROM ({_tok('documents', 'doc_id')}) t LEFT JOIN v ON t.token = v.token GROUP BY ALL), d AS (SELECT sum(n) AS n, sum(n) FILTER (o) AS o FROM n GROUP BY doc_id)
SELECT (SELECT sum(o) / sum(n) FROM d) AS token_oov, (SELECT count(*) FROM d WHERE o = n) AS n_all_oov, (SELECT avg(CAST(o AS INTEGER)) FROM (SELECT DISTINCT token, o FROM n)) AS type_oov
""")
def vocabulary_coverage(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return T.vocabulary_coverage(table(spark, sf_dir, "documents"), T.token_rows(b, "item_id", "text").select("token").distinct(), "doc_id", "text")


@query(f"WITH a AS (SELECT DISTINCT token FROM ({_tok('benchmark', 'item_id')})), b AS (SELECT DISTINCT token FROM ({_tok('conversations', 'conv_id')})), s AS (SELECT (SELECT count(*) FROM a JOIN b USING (token)) AS s, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS e, (SELECT count(*) FROM b) AS y) SELECT s AS shared, e AS either, s * 1.0 / e AS jaccard, 1 - s * 1.0 / y AS unseen_rate FROM s")
def vocabulary_overlap(spark, sf_dir):
    b, c = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "i"), table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "i")
    return T.vocabulary_overlap(b, c, "i", "text")


@query("""
WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 20 - 1, 0) + 1, 100)) AS b FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(b / 100 AS INTEGER) AS chunk_index, array_to_string(w[b + 1 : b + 120], ' ') AS content FROM s
""")
def chunks(spark, sf_dir):
    return T.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
WITH p AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[\\p{L}\\p{N}_''-]+')) AS token FROM part), h AS (SELECT p_partkey, 'ring' AS w, max(CASE WHEN token = 'ring' THEN 1.0 WHEN starts_with(token, 'ring') THEN 0.75 WHEN levenshtein(token, 'ring') <= 1 THEN 0.5 END) AS s FROM p GROUP BY 1 UNION ALL SELECT p_partkey, 'econ', max(CASE WHEN token = 'econ' THEN 1.0 WHEN starts_with(token, 'econ') THEN 0.75 WHEN levenshtein(token, 'econ') <= 1 THEN 0.5 END) FROM p GROUP BY 1)
SELECT p_partkey, CAST(sum(s) AS DOUBLE) AS score FROM h WHERE s IS NOT NULL GROUP BY 1 HAVING count(*) = 2 ORDER BY score DESC, p_partkey LIMIT 40
""")
def catalogue_search(spark, sf_dir):
    return T.search(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_type"], "econ ring")


@query(f"""
WITH t AS ({_tok('documents', 'doc_id')}), l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1), a AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM l) * 1.0 / (SELECT count(*) FROM documents) AS avg), f AS (SELECT doc_id, token, count(*) AS tf FROM t WHERE token IN ('that', 'heron') GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM f GROUP BY 1)
SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))) AS score FROM f JOIN d USING (token) JOIN l USING (doc_id), a GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 40
""")
def bm25_search(spark, sf_dir):
    return T.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", "that heron")
