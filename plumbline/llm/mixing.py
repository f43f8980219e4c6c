"""Mixing sources to target weights, each cut at its exact token budget.

Every document gets a key, a hash of its id and the seed; within a source the documents are in the order of their keys, which is
a random order that no rerun changes. As the keys are uniform, their leading bits are range buckets of equal size however hot a
source is. Tokens are summed for each bucket, the sums of a source's earlier buckets are a document's offset, and a window
within its bucket does the rest: a distributed prefix sum in which no task holds a whole source.

A source whose budget exceeds its tokens is repeated: epoch 1 in full, then epoch 2, ... and the last one cut. The document that
crosses the budget counts with the tokens that are still open (take_tokens), so each source's sum is its budget exactly.

A token is a run of characters other than blank, tab, line feed, carriage return and form feed.

Defined cases: null text counts as no tokens and is never drawn; so is an empty one. A null source is a source of its own, which
gets the default weight. Rows with a null doc_id are drawn, by the hash of their text. Rows that repeat the same doc_id (ties in the key) are ordered by the hash of their text; rows equal in both are
interchangeable, and each counts. Negative or missing weights are errors. An empty table gives an empty result. Further columns
pass through mix_documents.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import drop_written, fresh, written

SEED = 2024
WEIGHTS = {"src0": 6.0}
DEFAULT_WEIGHT = 1.0
TOKEN = r"[^ \t\n\r\f]+"
#: Documents that a (source, bucket) should have at most, about.
BUCKET_DOCS = 50_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _key(doc_id: Column, text: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(text))))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        token_count(text).alias("n_tokens"),
        _key(F.col(id_col), text, seed).alias("key"),
        F.md5(text).alias("tie"),
    ).where("n_tokens > 0")


def _budgets(totals: DataFrame, weights: Mapping[str, float], default: float, budget: int | None) -> DataFrame:
    """totals (source, total) with each source's budget: its share of the whole budget, rounded down."""
    if default < 0 or any(not w >= 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    w = F.lit(float(default))
    for name, value in weights.items():
        w = F.when(F.col("source") == name, F.lit(float(value))).otherwise(w)
    everything = Window.partitionBy(F.lit(1))
    whole = F.lit(budget).cast("long") if budget is not None else F.sum("total").over(everything)
    out = totals.withColumn("weight", w).withColumn("whole", whole).withColumn("weights", F.sum("weight").over(everything))
    return out.where("weight > 0").withColumn("budget", F.floor(F.col("whole") * F.col("weight") / F.col("weights")).cast("long"))


def _placed(docs: DataFrame, weights, default_weight, budget, seed, id_col, text_col, source_col) -> DataFrame:
    """(doc_id, source, n_tokens, key, tie, first, total, budget): first is the number of tokens before the document in its source."""
    keyed = written(_keyed(docs, id_col, text_col, source_col, seed), "keyed")
    n, digits = keyed.count(), 1
    while n / 16**digits > BUCKET_DOCS and digits < 8:
        digits += 1
    made = keyed
    keyed = keyed.withColumn("bucket", F.substring("key", 1, digits))
    sums = written(keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens")), "sums")
    budgets = _budgets(sums.groupBy("source").agg(F.sum("tokens").alias("total")), weights, default_weight, budget)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "offset")
    offsets = offsets.join(budgets.select(F.col("source").alias("_s2"), "total", "budget"), F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2")
    within = Window.partitionBy("source", "bucket").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("run", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    placed = placed.join(offsets, placed["source"].eqNullSafe(offsets["_s"]) & (placed["bucket"] == offsets["_b"]))
    out = placed.select("doc_id", "source", "n_tokens", "key", "tie", F.expr("`offset` + run").alias("first"), "total", "budget")
    out._plumbline_made = [made, sums]
    return out


def mix_plan(docs: DataFrame, *, weights: Mapping[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, budget: int | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, epoch, n_tokens, take_tokens, at_token): each draw of a document, how many of its tokens count, and where it begins in its source's stream.

    budget: tokens of the whole mixture; None takes as many as docs has."""
    placed = _placed(docs, weights, default_weight, budget, seed, id_col, text_col, source_col)
    # epoch e of a document begins at (e - 1) * total + first; it is drawn while that is below the budget
    draws = placed.where("first < budget").withColumn("epoch", F.explode(F.expr("sequence(1L, (budget - first - 1) div total + 1)")))
    return draws.select("doc_id", "source", "epoch", "n_tokens", F.expr("least(n_tokens, budget - (epoch - 1) * total - first)").alias("take_tokens"), F.expr("(epoch - 1) * total + first").alias("at_token"))


def cut_tokens(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th token."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([ \t\n\r\f]*[^ \t\n\r\f]+)"), F.lit(1)), 1, n.cast("int")), "")


def mix_documents(docs: DataFrame, *, weights: Mapping[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, budget: int | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_chars_col: str = "n_chars") -> DataFrame:
    """docs as drawn: a row for each draw, with the columns of docs. The text that crosses a budget ends with the last token that counts, and n_chars, if docs has it, tells its new length.

    No text is shuffled: a source's budget comes down to full epochs and a cut in the order of keys, and that table has a row for each source."""
    placed = _placed(docs, weights, default_weight, budget, seed, id_col, text_col, source_col)
    s, epochs, rest, cut_key, cut_tie, at, key, tie, k, n, j = fresh(docs, "_s", "_epochs", "_rest", "_cut_key", "_cut_tie", "_at", "_key", "_tie", "_k", "_n", "_j")
    open_ = F.expr("budget - (budget div total) * total")
    last = (F.col("first") < open_) & (open_ <= F.col("first") + F.col("n_tokens"))
    cuts = placed.groupBy("source").agg(
        F.first(F.expr("budget div total")).alias(epochs),
        F.first(open_).alias(rest),
        F.min(F.when(last, F.col("key"))).alias(cut_key),
        F.min(F.when(last, F.col("tie"))).alias(cut_tie),
    )
    # the rows at the cut are those that tie with the one that crosses; the first of them begins here
    cuts = written(cuts.withColumnRenamed("source", s), "cuts")
    first = cuts
    p = placed.join(cuts, placed["source"].eqNullSafe(cuts[s]) & (placed["key"] == cuts[cut_key]) & (placed["tie"] == cuts[cut_tie]))
    begin = p.groupBy(F.col(s).alias(s + "2")).agg(F.min("first").alias(at))
    cuts = written(cuts.join(begin, cuts[s].eqNullSafe(F.col(s + "2")), "left").drop(s + "2"), "cuts")
    # what led to the cuts isn't read any more
    drop_written(first, *placed._plumbline_made)
    text = F.col(text_col).cast("string")
    rows = docs.join(cuts, docs[source_col].cast("string").eqNullSafe(cuts[s])).withColumn(key, _key(F.col(id_col), text, seed)).withColumn(n, token_count(text)).where(F.col(n) > 0)
    order = (F.col(key) < F.col(cut_key)) | ((F.col(key) == F.col(cut_key)) & (F.md5(text) < F.col(cut_tie)))
    tied = F.coalesce((F.col(key) == F.col(cut_key)) & (F.md5(text) == F.col(cut_tie)), F.lit(False))
    draws = F.col(epochs) + F.when((F.col(rest) > 0) & F.coalesce(order, F.lit(False)), 1).otherwise(0)
    whole = rows.where(~tied).withColumn(k, F.explode(F.array_repeat(F.lit(0), draws.cast("int"))))
    at_cut = rows.where(tied).withColumn(j, F.row_number().over(Window.partitionBy(s).orderBy(F.lit(0))) - 1)
    take = F.least(F.col(n), F.greatest(F.lit(0), F.col(rest) - F.col(at) - F.col(j) * F.col(n)))
    parts = at_cut.withColumn(k, F.explode(F.concat(F.array_repeat(F.lit(-1).cast("bigint"), F.col(epochs).cast("int")), F.when(take > 0, F.array(take)).otherwise(F.array().cast("array<bigint>")))))
    shorter = (F.col(k) >= 0) & (F.col(k) < F.col(n))
    new = {text_col: F.when(shorter, cut_tokens(text, F.col(k))).otherwise(F.col(text_col))}
    if n_chars_col in docs.columns:
        new[n_chars_col] = F.when(shorter, F.length(cut_tokens(text, F.col(k))).cast(docs.schema[n_chars_col].dataType)).otherwise(F.col(n_chars_col))
    parts = parts.withColumns(new)
    return whole.select(*docs.columns).unionByName(parts.select(*docs.columns))


MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS BIGINT) AS n_tokens, md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), md5(text)))) AS key, md5(text) AS tie
  FROM documents WHERE text IS NOT NULL
), p AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY key, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM d WHERE n_tokens > 0
), t AS (
  SELECT source, sum(n_tokens) AS total, CASE WHEN source = 'src0' THEN {WEIGHTS["src0"]} ELSE {DEFAULT_WEIGHT} END AS weight FROM p GROUP BY source
), b AS (
  SELECT source, total, CAST(floor(CAST(sum(total) OVER () AS DOUBLE) * CAST(weight AS DOUBLE) / sum(CAST(weight AS DOUBLE)) OVER ()) AS BIGINT) AS budget FROM t
), e AS (
  SELECT p.*, b.total, b.budget, unnest(range(1, CAST((b.budget - p.first - 1) // b.total + 2 AS BIGINT))) AS epoch
  FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source WHERE p.first < b.budget
)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, n_tokens, CAST(least(n_tokens, budget - (epoch - 1) * total - first) AS BIGINT) AS take_tokens, CAST((epoch - 1) * total + first AS BIGINT) AS at_token FROM e
"""
