"""Texts: tokens, coverage, chunks, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import chunk_windows, collapse, normal_label, tokens


def token_rows(texts: DataFrame, id_col: str, text_col: str, lowercase: bool = True) -> DataFrame:
    return texts.select(F.col(id_col), F.explode(tokens(text_col, lowercase)).alias("token"))


def token_frequencies(texts: DataFrame, id_col: str, text_col: str, top: int = 1000) -> DataFrame:
    """(rank, token, n) of the top tokens; ties by token. The sort keeps `top` rows a task; ranks are given after it."""
    n = token_rows(texts, id_col, text_col).groupBy("token").agg(F.count("*").alias("n"))
    best = n.orderBy(F.desc("n"), "token").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "token"))).select("rank", "token", "n")


def text_summary(texts: DataFrame, text_col: str) -> DataFrame:
    """One row: n_docs, n_nan, n_empty_string (nothing but white space), and of the others n_empty_after_tokenization, duplicate_rate_normalized, characters and tokens (median, p95), vocab_size, hapax_share,
    top10_token_share and non_alpha_token_share (tokens without a letter)."""
    t = F.col(text_col).cast("string")
    d = texts.select(t.alias("t"), collapse(t).alias("c")).select("t", F.when(F.col("c") != "", F.col("t")).alias("v"), F.lower("c").alias("c")).select("t", "v", tokens("v").alias("k"), F.when(F.col("v").isNotNull(), F.xxhash64("c")).alias("h"))
    size = F.when(F.col("v").isNotNull(), F.size("k"))
    a = d.agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("t").isNull()).alias("n_nan"),
        F.count_if(F.col("t").isNotNull() & F.col("v").isNull()).alias("n_empty_string"),
        F.count_if(size == 0).alias("n_empty_after_tokenization"),
        F.median(F.length("v")).alias("chars_median"),
        F.percentile(F.length("v"), F.lit(0.95)).alias("chars_p95"),
        F.median(size).alias("tokens_median"),
        F.percentile(size, F.lit(0.95)).alias("tokens_p95"),
    )
    # equal texts are counted by hash, apart: a distinct count beside the others would write every row twice
    same = d.where("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("n")).agg(F.coalesce(F.round(1 - F.try_divide(F.count("*"), F.sum("n")), 4), F.lit(0.0)).alias("duplicate_rate_normalized"))
    v = d.select(F.explode("k").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    all_ = v.agg(F.count("*").alias("vocab_size"), F.round(F.avg((F.col("n") == 1).cast("int")), 4).alias("hapax_share"), F.sum("n").alias("_n"), F.sum(F.when(~F.col("token").rlike(r"\p{L}"), F.col("n")).otherwise(0)).alias("_o"))
    top = v.orderBy(F.desc("n")).limit(10).agg(F.sum("n").alias("_t"))
    share = lambda c: F.round(F.try_divide(F.col(c), F.col("_n")), 4)
    return a.crossJoin(same).crossJoin(all_).crossJoin(top).withColumns({"top10_token_share": share("_t"), "non_alpha_token_share": share("_o")}).drop("_n", "_o", "_t")


#: Words of a vocabulary that every executor gets at most.
MOST_WORDS = 1_000_000


def vocabulary_coverage(texts: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: shares of tokens and of types that the vocabulary (token) lacks, and texts all of whose tokens it lacks."""
    v = vocabulary.where("token IS NOT NULL").select(F.lower("token").alias("token"), F.lit(1).alias("known")).distinct()
    # with the words on every executor, a text's tokens stay where they are, and a row a text and a row a type are all that is shuffled
    v = F.broadcast(v) if v.limit(MOST_WORDS + 1).count() <= MOST_WORDS else v
    known = token_rows(texts, id_col, text_col).join(v, "token", "left").select(F.col(id_col).alias("id"), "token", F.coalesce("known", F.lit(0)).alias("known"))
    # of text and type, one is null: both sums come from one pass
    side = lambda text: F.struct(F.lit(text).alias("text"), F.when(F.lit(text), F.col("id")).alias("id"), F.when(F.lit(not text), F.col("token")).alias("token"))
    n = known.select(F.explode(F.array(side(True), side(False))).alias("r"), "known").groupBy("r.text", "r.id", "r.token").agg(F.count("*").alias("n"), F.sum(1 - F.col("known")).alias("o"))
    of = lambda c: F.when(F.col("text"), c)
    type_oov = F.avg(F.when(~F.col("text"), (F.col("o") > 0).cast("int")))
    return n.agg((F.sum(of(F.col("o"))) / F.sum(of(F.col("n")))).alias("token_oov"), F.count_if(F.col("text") & (F.col("o") == F.col("n"))).alias("n_all_oov"), type_oov.alias("type_oov"))


def vocabulary_overlap(a: DataFrame, b: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row (shared, either, jaccard, unseen_rate): of the tokens of two tables; unseen is of b."""
    x, y = (token_rows(d, id_col, text_col).select("token").distinct().withColumn(n, F.lit(1)) for d, n in ((a, "x"), (b, "y")))
    return x.join(y, "token", "full_outer").agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), F.count("*").alias("either"), F.count("y").alias("_y")).select("shared", "either", F.try_divide("shared", "either").alias("jaccard"), (1 - F.try_divide("shared", "_y")).alias("unseen_rate"))


def chunks(texts: DataFrame, id_col: str, text_col: str, size: int = 120, overlap: int = 20) -> DataFrame:
    """(id, chunk_index, content): windows of words, joined by blanks. A text without words has none."""
    words = F.filter(F.split(collapse(text_col), " "), lambda w: w != "")
    return texts.select(F.col(id_col), F.posexplode(chunk_windows(words, size, overlap)).alias("chunk_index", "w")).select(id_col, "chunk_index", F.array_join("w", " ").alias("content"))


def search(entries: DataFrame, id_col: str, fields: Sequence[str], query: str, most: int = 40) -> DataFrame:
    """(id, score): entries in which every word of the query begins a token or is within a fifth of its length of one. Tokens are matched once each, however many entries have them. An empty query finds everything."""
    words = sorted({w for w in query.lower().split() if w})
    if not words:
        return entries.select(id_col, F.lit(0.0).alias("score")).orderBy(id_col).limit(most)
    post = entries.select(F.col(id_col), F.explode(tokens(F.concat_ws(" ", *fields))).alias("token")).groupBy("token", id_col).agg(F.count("*").alias("n"))
    match = lambda w: F.when(F.col("token") == w, 1.0).when(F.col("token").startswith(w), 0.75).when(F.levenshtein("token", F.lit(w)) <= round(0.2 * len(w)), 0.5)
    hits = F.filter(F.array(*[F.struct(F.lit(k).alias("word"), match(w).alias("s")) for k, w in enumerate(words)]), lambda h: h["s"].isNotNull())
    found = post.select("token").distinct().select("token", F.explode(hits).alias("h"))
    best = post.join(found, "token").groupBy(id_col, "h.word").agg(F.max("h.s").alias("s"))
    return best.groupBy(id_col).agg(F.count("*").alias("_k"), F.sum("s").alias("score")).where(F.col("_k") == len(words)).drop("_k").orderBy(F.desc("score"), id_col).limit(most)


def bm25(entries: DataFrame, id_col: str, text_col: str, query: str, most: int = 40, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the best entries by BM25."""
    words = sorted(set(query.lower().split()))
    t = entries.select(F.col(id_col), tokens(text_col).alias("k"))
    size = t.agg(F.count("*").alias("_n"), F.avg(F.size("k")).alias("_avg"))
    tf = t.select(id_col, F.size("k").alias("len"), F.explode("k").alias("token")).where(F.col("token").isin(words)).groupBy(id_col, "len", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    s = tf.join(F.broadcast(df), "token").crossJoin(size)  # a row for each word of the query
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("_avg")))
    return s.groupBy(id_col).agg(F.sum(score).alias("score")).orderBy(F.desc("score"), id_col).limit(most)
