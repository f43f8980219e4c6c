"""Thresholds, ranking quality, agreement between raters and generalisation gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import levels, ordered_sums


def _all():
    """One window over all rows of a table that is small by then: levels, groups, distinct values."""
    return Window.partitionBy(F.lit(1))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0))


def sweep(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, tp, fp, fn, tn, tpr, fpr, precision, youden, balanced) of every distinct score as the threshold ("at least"), and of infinity.

    Scores are counted first and summed in their order by range buckets."""
    seen = levels(df.where(F.col(y).isNotNull() & F.col(score).isNotNull()), F.col(score).cast("double"), p=F.col(y).cast("long"))
    s = seen.unionByName(df.sparkSession.range(1).select(F.lit(float("inf")).alias("x"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("p")))
    s = ordered_sums(s, sums=("n", "p")).select(F.col("x").alias("threshold"), (F.col("p_all") - F.col("p_before")).alias("tp"), (F.col("n_all") - F.col("n_before") - F.col("p_all") + F.col("p_before")).alias("fp"), F.col("p_all").alias("_p"), (F.col("n_all") - F.col("p_all")).alias("_n"))
    tpr, fpr = F.coalesce(F.try_divide("tp", "_p"), F.lit(0.0)), F.coalesce(F.try_divide("fp", "_n"), F.lit(0.0))
    return s.select("threshold", "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"), tpr.alias("tpr"), fpr.alias("fpr"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), (tpr - fpr).alias("youden"), ((tpr + 1 - fpr) / 2).alias("balanced"))


def pick(sw: DataFrame, criterion: str, beta: float = 1.0, min_precision: float = 0.9) -> DataFrame:
    """The row of the sweep that is best by closest01, youden, balanced, fbeta or min-precision (greatest recall of at least that precision); ties go to the lowest threshold."""
    goal = {
        "closest01": -(F.pow("fpr", F.lit(2)) + F.pow(1 - F.col("tpr"), F.lit(2))),
        "youden": F.col("youden"),
        "balanced": F.col("balanced"),
        "fbeta": f_beta(F.coalesce("precision", F.lit(0.0)), F.col("tpr"), beta),
        "min-precision": F.when(F.col("precision") >= min_precision, F.col("tpr")),
    }[criterion]
    row = F.struct(*sw.columns)
    return sw.withColumn("_g", goal).where("_g IS NOT NULL").agg(F.min_by(row, F.struct(-F.round("_g", 12), F.col("threshold"))).alias("r")).select(F.lit(criterion).alias("criterion"), "r.*")


def _steps(df: DataFrame, y: str, score: str) -> DataFrame:
    """(x, n, p, ...): counted scores with the sums below them and over all."""
    return ordered_sums(levels(df.where(F.col(y).isNotNull() & F.col(score).isNotNull()), F.col(score).cast("double"), p=F.col(y).cast("long")), sums=("n", "p"))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: area under the curve by trapezoids: of all pairs of a positive and a negative, the share in which the positive scores higher, ties counting half. Null where a class is absent."""
    lost = F.col("n") - F.col("p")
    below = F.col("n_before") - F.col("p_before")
    return _steps(df, y, score).agg(F.try_divide(F.sum(F.col("p") * (below + lost / 2)), F.max("p_all").cast("double") * F.max(F.col("n_all") - F.col("p_all"))).alias("auc"))


def prevalence_report(df: DataFrame, y: str, score: str, recalls: Sequence[float] = (0.5, 0.8)) -> DataFrame:
    """One row: prevalence, AUC, average precision, and for each recall the precision at the highest threshold that reaches it and the alerts for one hit."""
    s = _steps(df, y, score)
    tp, all_ = F.col("p_all") - F.col("p_before"), F.col("n_all") - F.col("n_before")
    precision, recall = tp / all_, F.try_divide(tp, F.col("p_all"))
    lost, below = F.col("n") - F.col("p"), F.col("n_before") - F.col("p_before")
    at = s.agg(
        F.try_divide(F.max("p_all"), F.max("n_all")).alias("prevalence"),
        *[F.max_by(precision, F.when(recall >= r, F.col("x"))).alias(f"precision_at_{round(r * 100)}") for r in recalls],
        F.sum(F.try_divide("p", "p_all") * precision).alias("average_precision"),
        F.try_divide(F.sum(F.col("p") * (below + lost / 2)), F.max("p_all").cast("double") * F.max(F.col("n_all") - F.col("p_all"))).alias("auc"),
    )
    return at.withColumns({f"alerts_per_hit_at_{round(r * 100)}": F.try_divide(F.lit(1.0), F.col(f"precision_at_{round(r * 100)}")) for r in recalls})


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, agreement, kappa) of two raters."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    side = F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col("a").cast("string").alias("v")), F.struct(F.lit("b").alias("s"), F.col("b").cast("string").alias("v"))))
    m = c.select(side.alias("e"), "n").groupBy("e.v").agg(F.sum(F.when(F.col("e.s") == "a", F.col("n")).otherwise(0)).alias("x"), F.sum(F.when(F.col("e.s") == "b", F.col("n")).otherwise(0)).alias("y"))
    po = c.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("a").cast("string") == F.col("b").cast("string"), F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"))
    pe = m.agg((F.sum(F.col("x").cast("double") * F.col("y")) / (F.sum("x") * F.sum("y").cast("double"))).alias("_e"))
    return po.crossJoin(pe).select("n", "agreement", F.try_divide(F.col("agreement") - F.col("_e"), 1 - F.col("_e")).alias("kappa"))


def fleiss(ratings: DataFrame, item: str, category: str) -> DataFrame:
    """One row (items, kappa); every item needs as many ratings as the others."""
    c = ratings.groupBy(item, category).agg(F.count("*").alias("n"))
    each = c.groupBy(item).agg(F.sum("n").alias("r"), F.sum(F.col("n") * (F.col("n") - 1)).alias("q"))
    p = each.agg(F.count("*").alias("items"), F.avg(F.try_divide("q", F.col("r") * (F.col("r") - 1))).alias("_p"))
    e = c.groupBy(category).agg(F.sum("n").alias("n")).agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("_e"))
    return p.crossJoin(e).select("items", F.try_divide(F.col("_p") - F.col("_e"), 1 - F.col("_e")).alias("kappa"))


def generalisation_gap(df: DataFrame, train: str, test: str, greater_is_better: bool = True) -> DataFrame:
    """df with gap, relative to train, and verdict: below 0 anomaly (test beats train: look for a leak), below 15 % fine, 20 % watch, 30 % overfit, above severe. Null where train is 0."""
    g = F.try_divide(F.col(train) - F.col(test) if greater_is_better else F.col(test) - F.col(train), F.abs(F.col(train)))
    return df.withColumn("gap", g).withColumn("verdict", F.when(g < 0, "anomaly").when(g < 0.15, "fine").when(g < 0.2, "watch").when(g < 0.3, "overfit").when(g.isNotNull(), "severe"))


def beta_posterior(df: DataFrame, k: str, n: str, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """df with the mean and deviation of the Beta posterior of a rate."""
    a, b = F.col(k) + alpha, F.col(n) - F.col(k) + beta
    return df.withColumns({"posterior_mean": a / (a + b), "posterior_sd": F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))})
