"""Evaluation records and usage logs: outcomes, statistics by node, flips between runs, token usage and cost, titles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import first_wins


def outcome(grounded: Column, score: Column, threshold: Column, error: Column) -> Column:
    """Whether a record passes: not where it isn't fully grounded; by score and threshold where both are there; else unless there was an error."""
    return F.when(grounded < 1, False).when(score.isNotNull() & threshold.isNotNull(), score >= threshold).otherwise(error.isNull())


def node_stats(records: DataFrame, node: str, passed: str, label: str, seq: str, metrics: Sequence[str]) -> DataFrame:
    """(node, label, n, pass_rate, and for each metric its mean and sample deviation): label is that of the last record; a deviation of one value is 0."""
    aggs = [F.max_by(label, seq).alias("label"), F.count("*").alias("n"), F.avg(F.col(passed).cast("int")).alias("pass_rate")]
    for m in metrics:
        aggs += [F.coalesce(F.avg(m), F.lit(0.0)).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std")]
    return records.groupBy(node).agg(*aggs)


def practice_rates(records: DataFrame, node: str, practices: str) -> DataFrame:
    """(node, practice, n, pass_rate) of an array of (practice, passed)."""
    each = records.select(node, F.explode(practices).alias("p"))
    return each.groupBy(node, F.col("p.practice").alias("practice")).agg(F.count("*").alias("n"), F.avg(F.col("p.passed").cast("int")).alias("pass_rate"))


def flips(history: DataFrame, run: str, node: str, result: str, seq: str) -> DataFrame:
    """(node, before, after, flip) between the last two runs; of several results of a node in a run the last counts. flip: fixed, broken, same, new or gone."""
    last = history.groupBy(run, node).agg(F.max_by(result, seq).alias("r"))
    newest = [r[0] for r in history.select(run).distinct().orderBy(F.desc(run)).limit(2).collect()]
    a = last.where(F.col(run) == (newest[1] if len(newest) > 1 else None)).select(node, F.col("r").alias("before"))
    b = last.where(F.col(run) == (newest[0] if newest else None)).select(node, F.col("r").alias("after"))
    flip = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("before") == F.col("after"), "same").when(F.col("after") == "pass", "fixed").otherwise("broken")
    return a.join(b, node, "full_outer").select(node, "before", "after", flip.alias("flip"))


def price(model: Column, prices: Mapping[str, float], default: float) -> Column:
    """The price of the first pattern that a model's name has."""
    c = None
    for pattern, value in prices.items():
        c = F.when(model.rlike(pattern), F.lit(value)) if c is None else c.when(model.rlike(pattern), F.lit(value))
    return F.lit(default) if c is None else c.otherwise(F.lit(default))


def usage_totals(log: DataFrame, key: Sequence[str], seq: str, by: Sequence[str], fresh: str, cached: str, cost: Column) -> DataFrame:
    """(by..., calls, fresh, cached, cache_hit, cost): repeated log lines of a call count once, the first of them."""
    one = first_wins(log, key, [seq]).withColumn("_cost", cost)
    return one.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(fresh).alias("fresh"), F.sum(cached).alias("cached"), F.try_divide(F.sum(cached), F.sum(F.col(fresh) + F.col(cached))).alias("cache_hit"), F.sum("_cost").alias("cost"))


def titles(turns: DataFrame, key: str, turn: str, role: str, text: str, most: int = 70) -> DataFrame:
    """(key, title): the last title of a session, else its first text of a user, on one line and cut."""
    is_title, is_user = F.col(role) == "title", F.col(role) == "user"
    t = F.coalesce(F.max_by(F.when(is_title, F.col(text)), F.when(is_title, F.col(turn))), F.min_by(F.when(is_user, F.col(text)), F.when(is_user, F.col(turn))))
    return turns.groupBy(key).agg(F.substring(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), 1, most).alias("title"))


def attempts_by_day(runs: DataFrame, at: str, attempts: str) -> DataFrame:
    """(day, checkouts): every run counts once at least."""
    return runs.groupBy(F.substring(F.col(at).cast("string"), 1, 10).alias("day")).agg(F.sum(F.greatest(F.lit(1).cast("long"), F.coalesce(F.col(attempts).cast("long"), F.lit(1).cast("long")))).alias("checkouts"))


def marker_hits(texts: DataFrame, id_col: str, text_col: str, marker: str, negation: str = r"\b(no|not|never|without)\b", window: int = 30) -> DataFrame:
    """(id, hits, negated): how often a pattern occurs, and how often a negation stands within `window` characters before it."""
    near = F.regexp_extract_all(F.lower(text_col), F.lit(rf"(?s)((?:.{{0,{window}}}?))(?:{marker})"), F.lit(1))
    return texts.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.size(near).cast("long").alias("hits"), F.size(F.filter(near, lambda x: x.rlike(negation))).cast("long").alias("negated"))


def spans_by_key(log: DataFrame, key: str, at: str) -> DataFrame:
    """(key, seconds) from the first line to the last."""
    t = F.col(at).cast("timestamp").cast("double")
    return log.groupBy(key).agg((F.max(t) - F.min(t)).alias("seconds"))


def shared_reads(reads: DataFrame, item: str, context: str, least: int = 3, top: int = 12) -> DataFrame:
    """(item, contexts) of the items read in several contexts, the most shared first."""
    return reads.groupBy(item).agg(F.count_distinct(context).alias("contexts")).where(F.col("contexts") >= least).orderBy(F.desc("contexts"), item).limit(top)


def every_nth(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).where(F.col("_r") % n == 0).drop("_r")
