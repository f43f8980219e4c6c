"""The shape of one column: tails, moments, candidate families, histograms, and effects of selection and of cutting in two."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import finite
from ..functions.distributions import normal_quantile
from ..functions.ordering import levels, ordered_sums, quantiles


def tail_index(df: DataFrame, column: str, frac: float = 0.1) -> DataFrame:
    """One row (n, k, hill_alpha): Hill's estimate over the greatest share of the positive values; the threshold is the k+1-th greatest. Ranks come from counts by value."""
    r = ordered_sums(levels(df, F.when(finite(column) > 0, finite(column))))
    r = r.withColumns({"above": F.col("n_all") - F.col("n_before") - F.col("n"), "all": F.col("n_all")}).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("all") * frac)))
    r = r.withColumn("take", F.greatest(F.lit(0), F.least(F.col("n"), F.col("k") - F.col("above"))))
    a = r.agg(F.first("all").alias("n"), F.first("k").alias("k"), (F.sum(F.col("take") * F.log("x")) / F.first("k")).alias("m"), F.max(F.when((F.col("above") + F.col("n")) > F.col("k"), F.col("x"))).alias("x0"))
    return a.select("n", "k", F.try_divide(F.lit(1.0), F.col("m") - F.log("x0")).alias("hill_alpha"))


def signature(df: DataFrame, column: str) -> DataFrame:
    """One row: n, n_unique, range, whole and non-negative and unit-interval flags, zero share, skew, kurtosis, variance over mean."""
    x = finite(column)
    return df.where(x.isNotNull()).agg(
        F.count("*").alias("n"), F.count_distinct(x).alias("n_unique"), F.min(x).alias("least"), F.max(x).alias("greatest"), F.bool_and(x == F.floor(x)).alias("whole"), F.bool_and(x >= 0).alias("non_negative"), F.bool_and((x >= 0) & (x <= 1)).alias("unit"),
        F.avg((x == 0).cast("int")).alias("zero_share"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"), F.try_divide(F.var_samp(x), F.avg(x)).alias("variance_over_mean"),
    )


def families(sig: DataFrame, most: int = 6) -> DataFrame:
    """(rank, family): distributions that a signature admits, the likeliest first."""
    ladder = [
        (F.col("n_unique") <= 2, ["bernoulli"]),
        (F.col("whole") & F.col("non_negative") & (F.col("variance_over_mean") < 0.75), ["binomial", "poisson"]),
        (F.col("whole") & F.col("non_negative") & (F.col("variance_over_mean") <= 1.25), ["poisson", "negative binomial"]),
        (F.col("whole") & F.col("non_negative") & (F.col("zero_share") > 0.3), ["zero-inflated", "negative binomial", "poisson"]),
        (F.col("whole") & F.col("non_negative"), ["negative binomial", "zipf", "poisson"]),
        (F.col("unit"), ["beta", "uniform"]),
        (F.col("non_negative") & (F.col("skew") > 1), ["lognormal", "gamma", "weibull", "pareto", "exponential"]),
        (F.col("non_negative"), ["gamma", "weibull", "lognormal", "normal"]),
        (F.abs("skew") < 0.5, ["normal", "laplace", "student t", "logistic"]),
    ]
    c = None
    for cond, names in ladder:
        value = F.array(*map(F.lit, names))
        c = F.when(cond, value) if c is None else c.when(cond, value)
    c = c.otherwise(F.array(F.lit("skew normal"), F.lit("student t")))
    return sig.select(F.posexplode(F.slice(c, 1, most)).alias("k", "family")).select((F.col("k") + 1).alias("rank"), "family")


def fit_rank(df: DataFrame, column: str) -> DataFrame:
    """(family, log_likelihood, aic) of the families whose maximum likelihood is closed: normal and Laplace, and lognormal and exponential where all values are positive. Two passes."""
    x = finite(column)
    d = df.where(x.isNotNull()).select(x.alias("x"))
    med = quantiles(d, F.col("x"), [0.5], ["_m"])
    a = d.crossJoin(med).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("v"), F.avg(F.abs(F.col("x") - F.col("_m"))).alias("b"), F.min("x").alias("least"), F.avg(F.when(F.col("x") > 0, F.log("x"))).alias("lm"), F.var_pop(F.when(F.col("x") > 0, F.log("x"))).alias("lv"))
    n, c = F.col("n"), math.log(2 * math.pi)
    pos = F.col("least") > 0
    rows = F.array(
        F.struct(F.lit("normal").alias("family"), (-n / 2 * (c + F.log("v") + 1)).alias("ll"), F.lit(2).alias("p")),
        F.struct(F.lit("laplace").alias("family"), (-n * (F.log(2 * F.col("b")) + 1)).alias("ll"), F.lit(2).alias("p")),
        F.struct(F.lit("lognormal").alias("family"), F.when(pos, -n / 2 * (c + F.log("lv") + 1) - n * F.col("lm")).alias("ll"), F.lit(2).alias("p")),
        F.struct(F.lit("exponential").alias("family"), F.when(pos, -n * (F.log("mean") + 1)).alias("ll"), F.lit(1).alias("p")),
    )
    return a.select(F.explode(rows).alias("r")).where("r.ll IS NOT NULL").select("r.family", F.col("r.ll").alias("log_likelihood"), (2 * F.col("r.p") - 2 * F.col("r.ll")).alias("aic"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) of equal widths from the least value to the greatest; every bin has a row."""
    x = finite(column)
    span = df.agg(F.min(x).alias("_a"), F.max(x).alias("_z"))
    at = F.coalesce(F.least(F.lit(bins - 1).cast("long"), F.floor(F.try_divide(x - F.col("_a"), F.col("_z") - F.col("_a")) * bins)), F.lit(0).cast("long"))
    n = df.where(x.isNotNull()).crossJoin(span).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def modes(df: DataFrame, column: str, bins: Sequence[int] = (5, 10, 15, 30), prominence: float = 0.1) -> DataFrame:
    """(bins, n_modes): peaks that stand out by a share of the highest, at several bin counts."""
    rows = []
    for b in bins:
        n = [0, *(r.n for r in histogram(df, column, b).orderBy("bin").collect()), 0]  # `bins` numbers
        least, count, low, high, rising = prominence * max(n), 0, 0, 0, True
        for v in n[1:]:
            high, low = (max(high, v), low) if rising else (high, min(low, v))
            if rising and high - v > least:
                count, rising, low = count + 1, False, v
            elif not rising and v - low > least:
                rising, high = True, v
        rows.append((b, count))
    return df.sparkSession.createDataFrame(rows, "bins int, n_modes int")


def regression_to_mean(df: DataFrame, baseline: str, followup: str, q: float = 0.1) -> DataFrame:
    """One row: change of those selected below the q-quantile of baseline, the change that regression to the mean alone would bring (a line fitted on the others), and the excess."""
    b, f = finite(baseline), finite(followup)
    d = df.where(b.isNotNull() & f.isNotNull()).select(b.alias("b"), f.alias("f"))
    t = d.crossJoin(quantiles(d, F.col("b"), [q], ["_t"])).withColumn("s", F.col("b") <= F.col("_t"))
    a = t.agg(F.count_if("s").alias("n_selected"), F.avg(F.when(F.col("s"), F.col("f") - F.col("b"))).alias("change"), F.avg(F.when(F.col("s"), F.col("b"))).alias("_b"), F.regr_slope(F.when(~F.col("s"), F.col("f")), F.when(~F.col("s"), F.col("b"))).alias("_k"), F.regr_intercept(F.when(~F.col("s"), F.col("f")), F.when(~F.col("s"), F.col("b"))).alias("_i"))
    expected = F.col("_i") + F.col("_k") * F.col("_b") - F.col("_b")
    return a.select("n_selected", "change", expected.alias("expected"), (F.col("change") - expected).alias("excess"))


def dichotomization_cost(df: DataFrame, x: str, y: str, split: float = 0.5) -> DataFrame:
    """One row: correlation before and after cutting x at a quantile, the share of information kept, and what theory says for a normal x."""
    d = df.where(finite(x).isNotNull() & finite(y).isNotNull()).select(finite(x).alias("x"), finite(y).alias("y"))
    d = d.crossJoin(quantiles(d, F.col("x"), [split], ["_c"]))
    a = d.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r_before"), F.corr((F.col("x") > F.col("_c")).cast("double"), F.col("y")).alias("r_after"))
    z = normal_quantile(split)
    theory = (math.exp(-z * z / 2) / math.sqrt(2 * math.pi)) ** 2 / (split * (1 - split))
    kept = F.try_divide(F.col("r_after") * F.col("r_after"), F.col("r_before") * F.col("r_before"))
    return a.withColumns({"kept": kept, "theory": F.lit(theory)})


def scalar_corrections(df: DataFrame, r: str, rel_x: str, rel_y: str) -> DataFrame:
    """df with the correlation freed of unreliability (disattenuated) and the greatest one that can be observed (ceiling)."""
    root = F.sqrt(F.col(rel_x) * F.col(rel_y))
    return df.withColumns({"disattenuated": F.try_divide(F.col(r), root), "ceiling": root})


def range_restriction(df: DataFrame, r: str, sd_selected: str, sd_reference: str) -> DataFrame:
    """df with corrected: Thorndike's second case."""
    u = F.col(sd_reference) / F.col(sd_selected)
    return df.withColumn("corrected", F.col(r) * u / F.sqrt(1 + F.col(r) * F.col(r) * (u * u - 1)))
