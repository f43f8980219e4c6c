"""Association, sampling design, reliability and multivariate diagnostics.

What grows with the rows is summed in Spark, in one pass; what is left is a matrix of columns by columns, which numpy on the driver takes."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import finite
from ..functions.ordering import levels, ordered_extreme, ordered_sums, quantiles
from ..functions.distributions import chi2_tail, f_tail, normal_cdf, normal_quantile, t_quantile, t_tail


def _all():
    """One window over all rows of a table that is small by then: levels, groups, distinct values."""
    return Window.partitionBy(F.lit(1))


# ---------------------------------------------------------------- association


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n, row, col, total) of the pairs that occur; nulls in either are left out."""
    n = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    return n.withColumns({"row": F.sum("n").over(Window.partitionBy("x")), "col": F.sum("n").over(Window.partitionBy("y")), "total": F.sum("n").over(_all())})


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (chi2, n, v): bias-corrected; 0 with fewer than two levels. Empty cells count: chi2 is n (sum of n^2 / (row col) - 1)."""
    a = contingency(df, x, y).agg(F.first("total").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("row").cast("double") * F.col("col"))).alias("s"), F.count_distinct("x").cast("double").alias("r"), F.count_distinct("y").cast("double").alias("c"))
    chi2 = F.greatest(F.lit(0.0), F.col("n") * (F.col("s") - 1))
    m = F.col("n") - 1
    phi2 = F.greatest(F.lit(0.0), chi2 / F.col("n") - (F.col("r") - 1) * (F.col("c") - 1) / m)
    rr, cc = F.col("r") - (F.col("r") - 1) * (F.col("r") - 1) / m, F.col("c") - (F.col("c") - 1) * (F.col("c") - 1) / m
    v = F.when((F.col("r") < 2) | (F.col("c") < 2), F.lit(0.0)).otherwise(F.sqrt(F.try_divide(phi2, F.least(rr, cc) - 1)))
    return a.select(chi2.alias("chi2"), "n", v.alias("v"))


def correlation_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """One row (eta): square root of the share of the sum of squares that lies between categories."""
    v = finite(value)
    g = df.where(F.col(category).isNotNull() & v.isNotNull()).groupBy(category).agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s"))
    g = g.withColumn("all", F.sum(F.col("n") * F.col("m")).over(_all()) / F.sum("n").over(_all()))
    between, inside = F.sum(F.col("n") * F.pow(F.col("m") - F.col("all"), 2)), F.sum(F.col("n") * F.col("s"))
    return g.agg(F.sqrt(F.try_divide(between, between + inside)).alias("eta"))


def quetelet_table(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n, quetelet, contribution, residual) of every cell, empty ones too."""
    c = contingency(df, x, y)
    rows, cols = c.select("x", "row", "total").distinct(), c.select("y", "col").distinct()
    full = rows.crossJoin(cols).join(c.select("x", "y", "n"), ["x", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    e = F.col("row").cast("double") * F.col("col") / F.col("total")
    return full.select("x", "y", "n", (F.col("n") / e - 1).alias("quetelet"), (F.col("n") / F.col("total") * (F.col("n") / e - 1)).alias("contribution"), ((F.col("n") - e) / F.sqrt(e)).alias("residual"))


def tabular_regression(df: DataFrame, category: str, value: str) -> DataFrame:
    """(level, n, mean, std) of each level and of all rows, as "(all)"."""
    d = df.where(F.col(category).isNotNull() & F.col(value).isNotNull())
    g = d.rollup(category).agg(F.grouping(category).alias("g"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return g.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col(category).cast("string")).alias("level"), "n", "mean", "std")


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (mi): of two discrete columns, in nats. A plug-in estimate, not a nearest-neighbour one; bin continuous columns first."""
    return contingency(df, x, y).agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n").cast("double") * F.col("total") / (F.col("row").cast("double") * F.col("col")))).alias("mi"))


def binned(df: DataFrame, column: str, bins: int = 10, name: str | None = None) -> DataFrame:
    """df with the number of the quantile bin of column."""
    x, names = finite(column), [f"_e{k}" for k in range(1, bins)]
    edges = quantiles(df, x, [k / bins for k in range(1, bins)], names).select(F.array(*names).alias("_e"))
    return df.crossJoin(edges).withColumn(name or f"{column}_bin", F.size(F.filter("_e", lambda e: x > e))).drop("_e")


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the average-tie rank of column; null for a missing value. Ranks come from counts by value."""
    x = finite(column)
    v = ordered_sums(levels(df, x)).select(F.col("x").alias("_x"), (F.col("n_before") + (F.col("n") + 1) / 2).alias(name))
    return df.join(v, x == F.col("_x"), "left").drop("_x")


def rank_transform(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with average-tie rank / number of values."""
    n = df.agg(F.count(finite(column)).alias("_all"))
    return average_ranks(df, column, name).crossJoin(n).withColumn(name, F.col(name) / F.col("_all")).drop("_all")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (rho, n) over the rows that have both."""
    both = df.where(finite(x).isNotNull() & finite(y).isNotNull()).select(finite(x).alias("x"), finite(y).alias("y"))
    ranked = average_ranks(average_ranks(both, "x", "rx"), "y", "ry")
    return ranked.agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def compare_groups(df: DataFrame, value: str, by: str) -> DataFrame:
    """(metric, value, p_value, groups, n): of two groups cohens_d, first less second in the order of their names, with the p of the Mann-Whitney test (normal, with ties and continuity); of more
    epsilon_sq_rank, (h - k + 1) / (n - k) of the Kruskal-Wallis statistic h, with its p. No row for fewer groups. Groups are MOST_GROUPS at most."""
    d = df.where(finite(value).isNotNull() & F.col(by).isNotNull()).select(finite(value).alias("v"), F.col(by).alias("g"))
    g = _groups(average_ranks(d, "v", "r").groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s"), F.sum("r").alias("r")))
    ties = d.groupBy("v").count().agg(F.sum(F.pow("count", F.lit(3)) - F.col("count")).alias("t")).first().t or 0.0
    n, k, rows = sum(x.n for x in g), len(g), []
    if k == 2:
        a, b = g
        pooled = math.sqrt(((a.n - 1) * (a.s or 0) + (b.n - 1) * (b.s or 0)) / max(1, n - 2))
        u, mean = a.r - a.n * (a.n + 1) / 2, a.n * b.n / 2
        sd = math.sqrt(a.n * b.n / 12 * (n + 1 - ties / (n * (n - 1))))
        p = min(1.0, 2 * (1 - normal_cdf(max(0.0, abs(u - mean) - 0.5) / sd))) if sd else 1.0
        rows.append(("cohens_d", round((a.m - b.m) / pooled if pooled else 0.0, 4), p, k, n))
    elif k > 2:
        correction = 1 - ties / (n**3 - n)
        h = (12 / (n * (n + 1)) * sum(x.r**2 / x.n for x in g) - 3 * (n + 1)) / correction if correction > 0 else None
        rows.append(("epsilon_sq_rank", round((h - k + 1) / (n - k), 4) if h is not None and n > k else None, chi2_tail(h, k - 1) if h is not None else None, k, n))
    return df.sparkSession.createDataFrame(rows, "metric string, value double, p_value double, groups int, n long")


#: Groups whose sums go to the driver; more are an error.
MOST_GROUPS = 10_000


def _groups(g: DataFrame, by: str = "g") -> list:
    """Rows of grouped sums, in the order of the group."""
    rows = g.limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    return sorted(rows, key=lambda r: r[by])


def holm(p: DataFrame, column: str = "p") -> DataFrame:
    """p with adjusted: Holm's step-down; null for a null p. Equal p-values are counted first and have one adjusted value."""
    s = ordered_sums(levels(p, F.col(column)))
    s = ordered_extreme(s.select("x", ((F.col("n_all") - F.col("n_before")) * F.col("x")).alias("_q")), "_q", "_a")
    return _adjusted(p, column, s)


def benjamini_hochberg(p: DataFrame, column: str = "p") -> DataFrame:
    """p with adjusted: the step-up of Benjamini and Hochberg; null for a null p."""
    s = ordered_sums(levels(p, F.col(column)))
    s = ordered_extreme(s.select("x", (F.col("x") * F.col("n_all") / (F.col("n_before") + F.col("n"))).alias("_q")), "_q", "_a", "min", descending=True)
    return _adjusted(p, column, s)


def _adjusted(p: DataFrame, column: str, s: DataFrame) -> DataFrame:
    table = s.select(F.col("x").alias("_x"), F.least(F.lit(1.0), "_a").alias("adjusted"))
    return p.join(table, F.col(column).cast("double") == F.col("_x"), "left").drop("_x")


def pairwise_differences(df: DataFrame, category: str, value: str, least: int = 3, level: float = 0.95) -> DataFrame:
    """(a, b, difference, t, df, p, low, high, hedges_g, adjusted) of every two levels: Welch's t with Holm's correction. Only the groups' moments leave Spark."""
    g = df.where(F.col(category).isNotNull() & finite(value).isNotNull()).groupBy(F.col(category).cast("string").alias("c")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("s")).where(F.col("n") >= least)
    g = _groups(g, "c")
    rows = []
    for i, a in enumerate(g):
        for b in g[i + 1 :]:
            va, vb = a.s / a.n, b.s / b.n
            se = math.sqrt(va + vb)
            if not se:
                continue
            nu = (va + vb) ** 2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1))
            t = (a.m - b.m) / se
            pooled = math.sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2))
            half = t_quantile(0.5 + level / 2, nu) * se
            rows.append((a.c, b.c, a.m - b.m, t, nu, t_tail(t, nu), a.m - b.m - half, a.m - b.m + half, (a.m - b.m) / pooled * (1 - 3 / (4 * (a.n + b.n) - 9))))
    return holm(df.sparkSession.createDataFrame(rows, "a string, b string, difference double, t double, df double, p double, low double, high double, hedges_g double"))


# ---------------------------------------------------------------- sampling design


def intraclass_correlation(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(column, k, n, m0, icc, deff, n_eff): one-way analysis of variance, Kish's mean cluster size, design effect."""
    long = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("v")) for c in columns])).alias("e")).select("g", "e.*").where("v IS NOT NULL")
    g = long.groupBy("column", "g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    g = g.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("column")) / F.sum("n").over(Window.partitionBy("column")))
    a = g.groupBy("column").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("ssb"), F.sum(F.col("n") * F.col("s")).alias("ssw"))
    m0 = F.try_divide(F.col("n") - F.col("n2") / F.col("n"), F.col("k") - 1)
    msb, msw = F.try_divide("ssb", F.col("k") - 1), F.try_divide("ssw", F.col("n") - F.col("k"))
    a = a.withColumn("m0", m0).withColumn("icc", F.greatest(F.lit(0.0), F.try_divide(msb - msw, msb + (F.col("m0") - 1) * msw)))
    deff = 1 + (F.col("m0") - 1) * F.col("icc")
    return a.select("column", "k", "n", "m0", "icc", deff.alias("deff"), (F.col("n") / deff).alias("n_eff"))


def weight_design_effect(df: DataFrame, weight: str) -> DataFrame:
    """One row: Kish's effect n sum(w^2) / sum(w)^2 over finite weights above 0."""
    w = F.when(finite(weight) > 0, finite(weight))
    n = F.count(w)
    deff = F.try_divide(n * F.sum(w * w), F.sum(w) * F.sum(w))
    return df.agg(n.alias("n"), (F.count("*") - n).alias("n_dropped"), deff.alias("deff"), F.try_divide(n, deff).alias("n_eff"), F.try_divide(F.stddev_pop(w), F.avg(w)).alias("cv"), F.try_divide(F.max(w), F.min(w)).alias("range"))


def cluster_se(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: mean, naive standard error and the one that is robust to clusters."""
    v = df.where(finite(value).isNotNull() & F.col(group).isNotNull()).select(finite(value).alias("v"), F.col(group).alias("g"))
    g = v.groupBy("g").agg(F.sum("v").alias("s"), F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("q"))
    g = g.withColumn("mean", F.sum("s").over(_all()) / F.sum("n").over(_all()))
    a = g.agg(F.first("mean").alias("mean"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.pow(F.col("s") - F.col("n") * F.col("mean"), 2)).alias("r"), F.sum("q").alias("q"))
    naive = F.sqrt((F.col("q") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1) / F.col("n"))
    return a.select("mean", "n", "k", naive.alias("naive_se"), (F.sqrt(F.col("r") * F.col("k") / (F.col("k") - 1)) / F.col("n")).alias("cluster_se"))


def label_concurrency(spans: DataFrame, span_id: str, begin: str, end: str) -> DataFrame:
    """(span_id, mean_concurrency, uniqueness) over the whole-number steps from begin to end, both included; a span without one is left out.

    No step is listed: how many spans are live changes only where one begins or has ended, and a span's sums are those of all steps before its end less those before its begin. Sums of 1 / concurrency are whole numbers of 10^-21, so that no digit is lost by the difference."""
    low, high = F.ceil(begin).cast("long"), F.floor(end).cast("long") + 1
    s = spans.where(F.col(span_id).isNotNull()).select(F.col(span_id).alias("span_id"), low.alias("b"), high.alias("e")).where("b < e")
    turn = s.select(F.explode(F.array(F.struct(F.col("b").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("r")).groupBy(F.col("r.t").cast("double").alias("x")).agg(F.sum("r.d").alias("d"))
    live = ordered_sums(turn, sums=("d",), following=True).withColumns({"c": F.col("d_before") + F.col("d"), "steps": (F.col("next_x") - F.col("x")).cast("long")})
    part = F.when(F.col("c") > 0, F.round(F.col("steps") * 1e21 / F.col("c"))).otherwise(0.0).cast("decimal(38,0)")
    upto = ordered_sums(live.select("x", F.coalesce(F.col("c") * F.col("steps"), F.lit(0)).alias("w"), F.coalesce(part, F.lit(0).cast("decimal(38,0)")).alias("u")), sums=("w", "u"))
    at = lambda k: upto.select(F.col("x").cast("long").alias(k), F.col("w_before").alias(f"w{k}"), F.col("u_before").alias(f"u{k}"))
    # a hint, as spans are small by their files' size and would be sent to every executor
    met = s.join(at("b").hint("merge"), "b").join(at("e").hint("merge"), "e")
    a = met.groupBy("span_id").agg(F.sum(F.col("we") - F.col("wb")).alias("w"), F.sum(F.col("ue") - F.col("ub")).cast("double").alias("u"), F.sum(F.col("e") - F.col("b")).alias("n"))
    return a.select("span_id", (F.col("w") / F.col("n")).alias("mean_concurrency"), (F.col("u") / F.col("n") / 1e21).alias("uniqueness"))


def dyadic_design_effect(edges: DataFrame, value: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row: mean over edges, naive variance of it and the node jackknife's. Leaving a node out drops its edges; a self-loop is dropped once."""
    e = edges.where(F.col(value).isNotNull()).select(F.col(src).alias("s"), F.col(dst).alias("d"), F.col(value).cast("double").alias("v"))
    ends = e.select(F.explode(F.array_distinct(F.array("s", "d"))).alias("node"), "v").groupBy("node").agg(F.sum("v").alias("sv"), F.count("*").alias("sn"))
    whole = e.agg(F.sum("v").alias("tv"), F.count("*").alias("tn"), F.var_samp("v").alias("var"))
    out = ends.crossJoin(whole).where("tn > sn").withColumn("m", (F.col("tv") - F.col("sv")) / (F.col("tn") - F.col("sn")))
    return out.agg((F.first("tv") / F.first("tn")).alias("mean"), (F.first("var") / F.first("tn")).alias("naive_variance"), ((F.count("*") - 1) * F.var_pop("m")).alias("jackknife_variance"))


def effect_verdict(deff):
    """A column's verdict on a design effect."""
    return F.when(deff < 1.1, "negligible").when(deff < 1.5, "moderate").when(deff.isNotNull(), "substantial").otherwise("undetermined")


def overlapping_label_deff(df: DataFrame, horizon: str, n: str) -> DataFrame:
    """df with uniqueness, deff_overlap, n_eff and verdict of labels that each look `horizon` rows ahead."""
    h = F.greatest(F.col(horizon), F.lit(1))
    deff = F.greatest(F.lit(1.0), 1 + (h - 1) * (2 * h - 1) / (3.0 * h))
    return df.withColumns({"uniqueness": 1.0 / h, "deff_overlap": deff, "n_eff": F.col(n) / deff, "verdict": effect_verdict(deff)})


def effective_n_for_association(df: DataFrame, icc_x: str, icc_y: str, size: str, n: str) -> DataFrame:
    """df with deff_pair, n_eff_pair and verdict: an association suffers by the product of both columns' intraclass correlations, each held to 0 to 1 (0 where it is missing)."""
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(finite(c), F.lit(0.0))))
    deff = F.greatest(F.lit(1.0), 1 + (F.col(size) - 1) * held(icc_x) * held(icc_y))
    return df.withColumns({"deff_pair": deff, "n_eff_pair": F.col(n) / deff, "verdict": effect_verdict(deff)})


def design_effect_report(df: DataFrame, columns: Sequence[str], group: str | None = None, weight: str | None = None) -> DataFrame:
    """(column, deff_mean, deff_weights, deff_total, n_eff_total, verdict): clustering and unequal weights together; each is 1 where it isn't given. The product is exact where weights don't depend on the cluster."""
    if group:
        base = intraclass_correlation(df, group, columns).select("column", "n", F.col("deff").alias("deff_mean"))
    else:
        base = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count(finite(c)).alias("n"), F.lit(1.0).alias("deff_mean")) for c in columns]).alias("r")).select(F.inline("r"))
    w = weight_design_effect(df, weight).select(F.coalesce("deff", F.lit(1.0)).alias("deff_weights")) if weight else df.sparkSession.range(1).select(F.lit(1.0).alias("deff_weights"))
    total = F.coalesce("deff_mean", F.lit(1.0)) * F.col("deff_weights")
    return base.crossJoin(w).select("column", "deff_mean", "deff_weights", total.alias("deff_total"), (F.col("n") / total).alias("n_eff_total"), effect_verdict(total).alias("verdict"))


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    """One row (mean, weighted_mean, n): over rows that have a value and a finite weight above 0."""
    ok = finite(value).isNotNull() & (finite(weight) > 0)
    v, w = F.when(ok, finite(value)), F.when(ok, finite(weight))
    return df.agg(F.avg(v).alias("mean"), F.try_divide(F.sum(v * w), F.sum(w)).alias("weighted_mean"), F.count(v).alias("n"))


# ---------------------------------------------------------------- matrices of columns


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, covariance with n - 1) over the rows that have all columns: one pass, a row of sums a task. Values are shifted by a first row, so that large means cost no digits."""
    d = len(columns)
    rows = df.select(*[finite(c).alias(f"c{k}") for k, c in enumerate(columns)]).dropna()
    first = rows.first()
    if first is None:
        return 0, np.full(d, np.nan), np.full((d, d), np.nan)
    x = [F.col(f"c{k}") - first[k] for k in range(d)]
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s{k}") for k, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    n, s = sums.n, np.array([sums[f"s{k}"] for k in range(d)])
    p = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            p[i, j] = p[j, i] = sums[f"p{i}_{j}"]
    return n, s / n + np.array(first), (p - np.outer(s, s) / n) / max(1, n - 1)


def correlation(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    with np.errstate(invalid="ignore", divide="ignore"):
        return cov / np.outer(sd, sd)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) of every two columns a < b."""
    _, _, cov = moments(df, columns)
    r = correlation(cov)
    rows = [(columns[i], columns[j], None if np.isnan(r[i, j]) else float(r[i, j])) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def vif_of(r: np.ndarray) -> np.ndarray:
    """Variance inflation from a correlation matrix; infinite where a column is a combination of the others."""
    out = np.empty(len(r))
    for k in range(len(r)):
        rest = np.delete(np.arange(len(r)), k)
        b = np.linalg.lstsq(r[np.ix_(rest, rest)], r[rest, k], rcond=None)[0]
        r2 = float(r[rest, k] @ b)
        out[k] = np.inf if r2 >= 1 - 1e-10 else 1 / (1 - r2)
    return out


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, vif); null for a constant column."""
    _, _, cov = moments(df, columns)
    live = [k for k in range(len(columns)) if cov[k, k] > 0]
    v = dict(zip(live, vif_of(correlation(cov)[np.ix_(live, live)]), strict=True)) if live else {}
    return df.sparkSession.createDataFrame([(c, float(v[k]) if k in v else None) for k, c in enumerate(columns)], "column string, vif double")


def vif_prune(df: DataFrame, columns: Sequence[str], threshold: float = 10.0, keep: Sequence[str] = ()) -> DataFrame:
    """(step, dropped, vif): the column of greatest inflation goes until none is above the threshold; columns in keep never go. One pass over the rows in all."""
    _, _, cov = moments(df, columns)
    r, left, rows = correlation(cov), [k for k in range(len(columns)) if cov[k, k] > 0], []
    while len(left) > 1:
        v = vif_of(r[np.ix_(left, left)])
        able = [i for i in range(len(left)) if columns[left[i]] not in keep and v[i] > threshold]
        if not able:
            break
        worst = max(able, key=lambda i: (v[i], columns[left[i]]))
        rows.append((len(rows) + 1, columns[left[worst]], float(v[worst])))
        del left[worst]
    return df.sparkSession.createDataFrame(rows, "step int, dropped string, vif double")


def redundancy_blocks(df: DataFrame, columns: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """(column, block): average-linkage clusters of columns at |r| of at least the threshold."""
    _, _, cov = moments(df, columns)
    dist = 1 - np.abs(np.nan_to_num(correlation(cov)))
    blocks = [[k] for k in range(len(columns))]
    while len(blocks) > 1:
        gap, i, j = min((dist[np.ix_(blocks[i], blocks[j])].mean(), i, j) for i in range(len(blocks)) for j in range(i + 1, len(blocks)))
        if gap > 1 - threshold:
            break
        blocks[i] += blocks.pop(j)
    return df.sparkSession.createDataFrame([(columns[k], b) for b, ks in enumerate(sorted(blocks, key=min)) for k in ks], "column string, block int")


def semipartial(df: DataFrame, target: str, predictors: Sequence[str]) -> DataFrame:
    """(predictor, b, beta, sr2, r, r2_full): slopes, standardised slopes, the fall of R2 without the predictor, zero-order correlation."""
    _, _, cov = moments(df, [target, *predictors])
    r = correlation(cov)

    def fit(ks: list[int]) -> tuple[np.ndarray, float]:
        beta = np.linalg.lstsq(r[np.ix_(ks, ks)], r[ks, 0], rcond=None)[0] if ks else np.zeros(0)
        return beta, float(r[ks, 0] @ beta) if ks else 0.0

    every = list(range(1, len(predictors) + 1))
    beta, r2 = fit(every)
    rows = [(p, float(beta[k] * math.sqrt(cov[0, 0] / cov[k + 1, k + 1])), float(beta[k]), r2 - fit([x for x in every if x != k + 1])[1], float(r[0, k + 1]), r2) for k, p in enumerate(predictors)]
    return df.sparkSession.createDataFrame(rows, "predictor string, b double, beta double, sr2 double, r double, r2_full double")


def leverage(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(id, leverage, high): hat values with an intercept; high beyond 3 p / n. The inverse is p by p; every row's value is a column expression."""
    n, mean, cov = moments(df, columns)
    inv = np.linalg.pinv(cov * (n - 1))
    d = [finite(c) - float(m) for c, m in zip(columns, mean, strict=True)]
    h = F.lit(1.0 / n) + sum((F.lit(float(inv[i, j])) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return df.select(F.col(id_col), h.alias("leverage")).where("leverage IS NOT NULL").withColumn("high", F.col("leverage") > 3 * (len(columns) + 1) / n)


def influence(df: DataFrame, id_col: str, target: str, predictors: Sequence[str]) -> DataFrame:
    """(id, residual, leverage, studentised, cooks_d, dffits) of a linear fit of target; studentised residuals are deleted ones."""
    n, mean, cov = moments(df, [target, *predictors])
    p = len(predictors) + 1
    inv = np.linalg.pinv(cov[1:, 1:] * (n - 1))
    b = np.linalg.lstsq(cov[1:, 1:], cov[1:, 0], rcond=None)[0]
    sse = float((cov[0, 0] - b @ cov[1:, 0]) * (n - 1))
    d = [finite(c) - float(m) for c, m in zip(predictors, mean[1:], strict=True)]
    e = finite(target) - float(mean[0]) - sum((F.lit(float(w)) * x for w, x in zip(b, d, strict=True)), F.lit(0.0))
    h = F.lit(1.0 / n) + sum((F.lit(float(inv[i, j])) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    out = df.select(F.col(id_col), e.alias("residual"), h.alias("leverage")).where("residual IS NOT NULL AND leverage IS NOT NULL")
    e, h = F.col("residual"), F.col("leverage")
    t = e / F.sqrt(F.greatest(F.lit(1e-300), (sse - e * e / (1 - h)) / (n - p - 1)) * (1 - h))
    return out.select(id_col, "residual", "leverage", t.alias("studentised"), (e * e * h / (p * (sse / (n - p)) * (1 - h) * (1 - h))).alias("cooks_d"), (t * F.sqrt(h / (1 - h))).alias("dffits"))


def cronbach_alpha(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """One row (n, k, alpha, standardised, mean_r)."""
    n, _, cov = moments(df, items)
    k = len(items)
    r = correlation(cov)
    mean_r = float((r.sum() - k) / (k * (k - 1)))
    return df.sparkSession.createDataFrame([(n, k, float(k / (k - 1) * (1 - np.trace(cov) / cov.sum())), k * mean_r / (1 + (k - 1) * mean_r), mean_r)], "n long, k int, alpha double, standardised double, mean_r double")


def item_statistics(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """(item, item_rest_r, alpha_without)."""
    _, _, cov = moments(df, items)
    rows = []
    for i, name in enumerate(items):
        rest = [j for j in range(len(items)) if j != i]
        sub, k = cov[np.ix_(rest, rest)], len(items) - 1
        rows.append((name, float(cov[i, rest].sum() / math.sqrt(cov[i, i] * sub.sum())), float(k / (k - 1) * (1 - np.trace(sub) / sub.sum())) if k > 1 else None))
    return df.sparkSession.createDataFrame(rows, "item string, item_rest_r double, alpha_without double")


def principal_axes(r: np.ndarray, factors: int, most: int = 200, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(loadings, communalities) by iterated principal axes; communalities stay at most 1."""
    h = 1 - 1 / np.maximum(vif_of(r), 1 + 1e-9)
    for _ in range(most):
        a = r.copy()
        np.fill_diagonal(a, h)
        w, v = np.linalg.eigh(a)
        load = v[:, ::-1][:, :factors] * np.sqrt(np.maximum(w[::-1][:factors], 0))
        new = np.minimum((load**2).sum(axis=1), 1.0)
        if np.abs(new - h).max() < tol:
            break
        h = new
    return load * np.where(load.sum(axis=0) < 0, -1, 1), new


def varimax(loadings: np.ndarray, most: int = 200, tol: float = 1e-8) -> np.ndarray:
    p, k = loadings.shape
    turn, last = np.eye(k), 0.0
    for _ in range(most):
        x = loadings @ turn
        u, s, vt = np.linalg.svd(loadings.T @ (x**3 - x * (x**2).sum(axis=0) / p))
        turn = u @ vt
        if s.sum() - last < tol:
            break
        last = s.sum()
    return loadings @ turn


def promax(loadings: np.ndarray, power: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, factor correlations)."""
    x = varimax(loadings)
    u = np.linalg.lstsq(x, x * np.abs(x) ** (power - 1), rcond=None)[0]
    u = u @ np.diag(np.sqrt(np.diag(np.linalg.inv(u.T @ u))))
    return x @ u, np.linalg.inv(u.T @ u)


def factor_loadings(df: DataFrame, columns: Sequence[str], factors: int = 1) -> DataFrame:
    """(item, factor, loading, communality), rotated by varimax where there are several factors."""
    _, _, cov = moments(df, columns)
    load, h = principal_axes(correlation(cov), factors)
    load = varimax(load) if factors > 1 else load
    return df.sparkSession.createDataFrame([(c, f + 1, float(load[k, f]), float(h[k])) for k, c in enumerate(columns) for f in range(factors)], "item string, factor int, loading double, communality double")


def mcdonald_omega(df: DataFrame, items: Sequence[str]) -> float:
    _, _, cov = moments(df, items)
    load, h = principal_axes(correlation(cov), 1)
    s = float(load.sum()) ** 2
    return s / (s + float((1 - h).sum()))


def rotate_loadings(loadings: np.ndarray, method: str = "promax") -> tuple[np.ndarray, np.ndarray]:
    """(loadings, factor correlations) rotated by "varimax" or "promax", or as they are ("none"); a single factor isn't rotated."""
    k = loadings.shape[1]
    if method == "none" or k < 2:
        return loadings, np.eye(k)
    return promax(loadings) if method == "promax" else (varimax(loadings), np.eye(k))


def tau_equivalence(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """One row (n, alpha, omega, observed_gap, loading_sd, cutoff, verdict): whether items load alike, so that alpha will do. The cutoff falls with the rows to 0.1; the gap of omega and alpha is told, and decides nothing."""
    n, _, cov = moments(df, items)
    if len(items) < 3 or n < 10:
        verdict = "too_few_items" if len(items) < 3 else "insufficient_rows"
        return df.sparkSession.createDataFrame([(n, None, None, None, None, None, verdict)], _TAU)
    load, h = principal_axes(correlation(cov), 1)
    alpha, s = _alpha(cov), float(load.sum()) ** 2
    omega, sd, cutoff = s / (s + float((1 - h).sum())), float(load.std(ddof=1)), max(0.1, 1.4 / math.sqrt(n))
    verdict = "improper_solution_heywood" if h.max() >= 1 else "tau_equivalent_alpha_is_appropriate" if sd <= cutoff else "mildly_congeneric_gap_is_negligible" if sd <= 0.2 else "congeneric_prefer_omega"
    return df.sparkSession.createDataFrame([(n, alpha, omega, omega - alpha, sd, cutoff, verdict)], _TAU)


_TAU = "n long, alpha double, omega double, observed_gap double, loading_sd double, cutoff double, verdict string"


def _alpha(cov: np.ndarray) -> float:
    k = len(cov)
    return float(k / (k - 1) * (1 - np.trace(cov) / cov.sum()))


def indicator_direction(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """One row (n, alpha, mean_inter_item_r, n_negative_pairs, verdict): items that hardly go together may be causes of what they are to measure, or a broken scale."""
    n, _, cov = moments(df, items)
    schema = "n long, alpha double, mean_inter_item_r double, n_negative_pairs int, verdict string"
    if len(items) < 3 or n < 10:
        return df.sparkSession.createDataFrame([(n, None, None, None, "too_few_items" if len(items) < 3 else "insufficient_rows")], schema)
    r, alpha = correlation(cov)[np.triu_indices(len(items), 1)], _alpha(cov)
    odd = np.nanmean(r) < 0.1 or alpha < 0.3
    return df.sparkSession.createDataFrame([(n, alpha, round(float(np.nanmean(r)), 4), int((r < 0).sum()), "formative_or_broken_reflective_scale_suspected" if odd else "consistent_with_reflective_indicators")], schema)


def positive_definite(r: np.ndarray) -> tuple[float, float, bool, int]:
    """(least eigenvalue, determinant, whether all are above zero, how many are below) of a symmetric matrix."""
    w = np.linalg.eigvalsh(r)
    return float(w.min()), float(np.linalg.det(r)), bool(w.min() > 0), int((w < 0).sum())


def eigenvalue_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rank, eigenvalue, share, kaiser) of the correlation matrix."""
    _, _, cov = moments(df, columns)
    w = np.linalg.eigvalsh(correlation(cov))[::-1]
    return df.sparkSession.createDataFrame([(k + 1, float(x), float(x / len(w)), bool(x > 1)) for k, x in enumerate(w)], "rank int, eigenvalue double, share double, kaiser boolean")


def parallel_analysis(df: DataFrame, columns: Sequence[str], sims: int = 200, percentile: float = 95, seed: int = 42) -> DataFrame:
    """(rank, eigenvalue, chance, retained): eigenvalues against those of independent normal data of the same size, drawn by Bartlett's decomposition, whatever the number of rows."""
    n, _, cov = moments(df, columns)
    d, rng = len(columns), np.random.default_rng(seed)
    found = []
    for _ in range(sims):
        a = np.tril(rng.normal(size=(d, d)), -1) + np.diag(np.sqrt(rng.chisquare(np.maximum(1, n - 1 - np.arange(d)))))
        found.append(np.linalg.eigvalsh(correlation(a @ a.T))[::-1])
    chance = np.percentile(found, percentile, axis=0)
    w, rows, on = np.linalg.eigvalsh(correlation(cov))[::-1], [], True
    for k in range(d):
        on = on and w[k] > chance[k]
        rows.append((k + 1, float(w[k]), float(chance[k]), bool(on)))
    return df.sparkSession.createDataFrame(rows, "rank int, eigenvalue double, chance double, retained boolean")


def ordinal_thresholds(df: DataFrame, column: str) -> DataFrame:
    """(level, n, threshold): normal quantiles of the cumulative shares, kept half a row away from 0 and 1; null for the last level."""
    levels = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).count().orderBy("level").collect()
    n, cum, rows = sum(x["count"] for x in levels), 0, []
    for k, x in enumerate(levels):
        cum += x["count"]
        rows.append((float(x.level), x["count"], normal_quantile(min(max(cum / n, 0.5 / n), 1 - 0.5 / n)) if k < len(levels) - 1 else None))
    return df.sparkSession.createDataFrame(rows, "level double, n long, threshold double")


def _bivariate_cdf(h: np.ndarray, k: np.ndarray, rho: float, nodes=np.polynomial.legendre.leggauss(48)) -> np.ndarray:  # noqa: B008
    """P(X < h, Y < k) of the standard bivariate normal, by integrating over the angle of the correlation."""
    x, w = nodes
    a = math.asin(rho) / 2
    theta = a * (x + 1)
    s, c2 = np.sin(theta), np.cos(theta) ** 2
    hh, kk = h[..., None], k[..., None]
    f = np.exp(-(hh**2 - 2 * hh * kk * s + kk**2) / (2 * c2))
    phi = np.vectorize(normal_cdf)
    return phi(h) * phi(k) + a * (f * w).sum(axis=-1) / (2 * math.pi)


def polychoric(df: DataFrame, x: str, y: str) -> float:
    """Two-step maximum likelihood from the table of counts, which is all that leaves Spark."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).count().collect()
    xs, ys = sorted({c.x for c in cells}), sorted({c.y for c in cells})
    table = np.zeros((len(xs), len(ys)))
    for c in cells:
        table[xs.index(c.x), ys.index(c.y)] = c["count"]
    if min(table.shape) < 2:
        return float("nan")
    n = table.sum()
    cut = lambda m: np.array([-8.0, *(normal_quantile(p) for p in np.clip(np.cumsum(m)[:-1] / n, 0.5 / n, 1 - 0.5 / n)), 8.0])
    a, b = np.meshgrid(cut(table.sum(axis=1)), cut(table.sum(axis=0)), indexing="ij")

    def loss(rho: float) -> float:
        f = _bivariate_cdf(a, b, rho)
        p = f[1:, 1:] - f[:-1, 1:] - f[1:, :-1] + f[:-1, :-1]
        return -float((table * np.log(np.maximum(p, 1e-12))).sum())

    lo, hi, g = -0.999, 0.999, (math.sqrt(5) - 1) / 2
    c, d = hi - g * (hi - lo), lo + g * (hi - lo)
    fc, fd = loss(c), loss(d)
    while hi - lo > 1e-5:
        if fc < fd:
            hi, d, fd = d, c, fc
            c = hi - g * (hi - lo)
            fc = loss(c)
        else:
            lo, c, fc = c, d, fd
            d = lo + g * (hi - lo)
            fd = loss(d)
    return (lo + hi) / 2


def polyserial(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, n_categories, rho, rho_unclipped, pearson_r, verdict): of a number and an ordinal code cut from a normal latent variable. Codes are counted by their ranks; rho is held to -1 to 1."""
    d = df.where(finite(x).isNotNull() & F.col(y).isNotNull()).select(finite(x).alias("x"), F.col(y).alias("y"))
    g = _groups(d.groupBy("y").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")), "y")
    n, schema = sum(r.n for r in g), "n long, n_categories int, rho double, rho_unclipped double, pearson_r double, verdict string"
    row = lambda *v: df.sparkSession.createDataFrame([v], schema)
    if n < 10 or len(g) < 2:
        return row(n, len(g), None, None, None, "insufficient_rows" if n < 10 else "constant_column")
    w = np.array([r.n for r in g], float)
    code, m, v = np.arange(len(g)), np.array([r.m for r in g]), np.array([r.v for r in g])
    mean_c, mean_x = (w * code).sum() / n, (w * m).sum() / n
    var_c, var_x = (w * (code - mean_c) ** 2).sum() / n, (w * (v + (m - mean_x) ** 2)).sum() / n
    if not var_x:
        return row(n, len(g), None, None, None, "no_variance")
    r = (w * (code - mean_c) * (m - mean_x)).sum() / n / math.sqrt(var_c * var_x)
    taus = [normal_quantile(c / n) for c in np.cumsum(w)[:-1]]
    rho = r * math.sqrt(var_c * n / (n - 1)) / sum(math.exp(-t * t / 2) / math.sqrt(2 * math.pi) for t in taus)
    return row(n, len(g), round(float(np.clip(rho, -1, 1)), 4), round(float(rho), 4), round(float(r), 4), "exceeds_unity_check_the_ordinal_model" if abs(rho) > 1 else "measured")


def polychoric_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, polychoric, pearson, smoothed) of every two ordinal columns over the rows that have all; smoothed are those of the nearest matrix whose eigenvalues are at least 1e-6."""
    d = df.dropna(subset=list(columns))
    r, p = np.eye(len(columns)), correlation(moments(d, columns)[2])
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            r[i, j] = r[j, i] = polychoric(d, columns[i], columns[j])
    w, v = np.linalg.eigh(r)
    s = v @ np.diag(np.maximum(w, 1e-6)) @ v.T
    s /= np.sqrt(np.outer(np.diag(s), np.diag(s)))
    rows = [(columns[i], columns[j], float(r[i, j]), float(p[i, j]), float(s[i, j])) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, polychoric double, pearson double, smoothed double")


# ---------------------------------------------------------------- resampling


def bootstrap_ci(df: DataFrame, id_col: str, value: str, n_boot: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """One row (mean, low, high, n): percentile interval of the mean. Each row counts in each replicate by a Poisson(1) draw from the hash of its id, so replicates are sums of one pass and nothing is resampled by place."""
    x = df.where(finite(value).isNotNull()).select(F.col(id_col).alias("i"), finite(value).alias("v"))
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    u = F.pmod(F.xxhash64("i", "b", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    w = sum(((u >= float(c)).cast("int") for c in cuts), F.lit(0))
    reps = x.select("i", "v", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("b")).withColumn("w", w).groupBy("b").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m"))
    a = (1 - level) / 2
    q = reps.agg(F.percentile("m", F.array(F.lit(a), F.lit(1 - a))).alias("q"))
    return x.agg(F.avg("v").alias("mean"), F.count("*").alias("n")).crossJoin(q).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n")


def permutation_test(df: DataFrame, id_col: str, value: str, group: str, n_perm: int = 1000, seed: int = 42) -> DataFrame:
    """One row (difference, p): two-sided, of the difference of two groups' means. A replicate deals labels by the order of hashes of the ids."""
    x = df.where(finite(value).isNotNull() & F.col(group).isNotNull()).select(F.col(id_col).alias("i"), finite(value).alias("v"), F.col(group).cast("int").alias("g"))
    a = x.agg(F.sum("g").alias("na"), F.count("*").alias("n"), (F.avg(F.when(F.col("g") == 1, F.col("v"))) - F.avg(F.when(F.col("g") == 0, F.col("v")))).alias("d")).first()
    k = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("i", "b", F.lit(seed)), "i"))
    reps = x.select("i", "v", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("b")).withColumn("one", k <= (a.na or 0))
    d = reps.groupBy("b").agg((F.avg(F.when(F.col("one"), F.col("v"))) - F.avg(F.when(~F.col("one"), F.col("v")))).alias("d"))
    return d.agg(F.lit(a.d).cast("double").alias("difference"), ((F.count_if(F.abs("d") >= abs(a.d or 0.0) - 1e-12) + 1) / (n_perm + 1)).alias("p"))


def by_replicate(df: DataFrame, n: int, seed: int, statistic: Callable) -> DataFrame:
    """(b, value): any statistic (pandas Series to float) of bootstrap samples, each in one task; samples are drawn by Poisson weights."""
    import pandas as pd

    col = df.columns[0]
    reps = df.select(F.col(col).cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("b"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        b = int(part["b"].iloc[0])
        w = np.random.default_rng([seed, b]).poisson(1, len(part))
        return pd.DataFrame({"b": [b], "value": [float(statistic(pd.Series(np.repeat(np.sort(part["v"].to_numpy()), w))))]})

    return reps.groupBy("b").applyInPandas(run, "b int, value double")


def anova_p(msb: float, msw: float, df1: int, df2: int) -> float:
    return f_tail(msb / msw, df1, df2) if msw else 0.0


def chi2_p(x: float, df: int) -> float:
    return chi2_tail(x, df)


def bootstrap_diff_ci(df: DataFrame, id_col: str, value: str, group: str, n_boot: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """One row (estimate, low, high, excludes_zero, n_a, n_b): percentile interval of the difference of the means of two groups (group is true for the first), resampled each on its own. As in bootstrap_ci, a row counts in a replicate by a Poisson(1) draw."""
    x = df.where(finite(value).isNotNull() & F.col(group).isNotNull()).select(F.col(id_col).alias("i"), finite(value).alias("v"), F.col(group).cast("boolean").alias("g"))
    w = _poisson(seed)
    reps = x.select("i", "v", "g", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("b")).withColumn("w", w).groupBy("b", "g").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m"))
    d = reps.groupBy("b").agg((F.max(F.when(F.col("g"), F.col("m"))) - F.max(F.when(~F.col("g"), F.col("m")))).alias("d"))
    a = (1 - level) / 2
    q = quantiles(d, F.col("d"), [a, 1 - a], ["low", "high"])
    n = x.agg((F.avg(F.when(F.col("g"), F.col("v"))) - F.avg(F.when(~F.col("g"), F.col("v")))).alias("estimate"), F.count_if("g").alias("n_a"), F.count_if(~F.col("g")).alias("n_b"))
    return n.crossJoin(q).select(F.round("estimate", 6).alias("estimate"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), ((F.col("low") > 0) | (F.col("high") < 0)).alias("excludes_zero"), "n_a", "n_b")


def _poisson(seed: int):
    """How often row i counts in replicate b."""
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    u = F.pmod(F.xxhash64("i", "b", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return sum(((u >= float(c)).cast("int") for c in cuts), F.lit(0))


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Rank correlations of every two columns over the rows that have all of them."""
    d = df.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)))
    for c in columns:
        d = average_ranks(d, c, f"_rank_{c}")
    return correlation(moments(d, [f"_rank_{c}" for c in columns])[2])


def prune_redundant(df: DataFrame, columns: Sequence[str], scores: Sequence[float] | None = None, method: str = "spearman", threshold: float = 0.9) -> DataFrame:
    """(column, kept, because_of): in the order of scores (or as given), a column is kept unless it correlates with a kept one at the threshold or above, in size; that one is named."""
    r = np.abs(spearman_matrix(df, columns) if method == "spearman" else correlation(moments(df, columns)[2]))
    order = sorted(range(len(columns)), key=lambda k: -scores[k]) if scores is not None else range(len(columns))
    kept, rows = [], []
    for k in order:
        twin = next((j for j in kept if r[k, j] >= threshold), None)
        rows.append((columns[k], twin is None, None if twin is None else columns[twin]))
        if twin is None:
            kept.append(k)
    return df.sparkSession.createDataFrame(rows, "column string, kept boolean, because_of string")


#: Relative residuals below it are found from rows, as moments have lost most of their digits.
UNSURE = 1e-3


def composite_target_probe(df: DataFrame, columns: Sequence[str], target: str, exact: float = 1e-6, near: float = 0.05) -> DataFrame:
    """One row (verdict, relative_residual, r2, n, most_redundant, minimal_subset, intercept, weights, looks_like_plain_sum): whether the target is a linear combination of columns.

    verdict: insufficient_rows (fewer than twice the coefficients), degenerate_target, exact_identity, near_identity, no_identity. For an identity, columns are dropped while the residual stays within ten times the whole one."""
    names = list(columns)
    schema = "verdict string, relative_residual double, r2 double, n long, most_redundant string, minimal_subset array<string>, intercept double, weights array<double>, looks_like_plain_sum boolean"
    row = lambda *v: df.sparkSession.createDataFrame([tuple(v) + (None,) * (9 - len(v))], schema)
    n, mean, cov = moments(df, [*names, target])
    if not n or not names or n < 2 * (len(names) + 1):
        return row("insufficient_rows", None, None, n)
    if cov[-1, -1] == 0:
        return row("degenerate_target", None, None, n)

    def fitted(chosen: list[int]) -> tuple[float, np.ndarray]:
        """(residual over the target's deviation, weights), from moments scaled to one."""
        scale = np.sqrt(np.maximum(np.diag(cov)[chosen], 1e-300))
        a, b = cov[np.ix_(chosen, chosen)] / np.outer(scale, scale), cov[chosen, -1] / scale
        w = np.linalg.lstsq(a, b, rcond=1e-12)[0]
        left = cov[-1, -1] - 2 * w @ b + w @ a @ w
        return float(np.sqrt(max(left, 0) / cov[-1, -1])), w / scale

    rows = df.select(*[finite(c).alias(f"c{k}") for k, c in enumerate([*names, target])]).dropna()

    def residual(chosen: list[int]) -> tuple[float, np.ndarray, float]:
        """As fitted, and how far the means are off the fit; where moments can't tell, as what they lose grows with the rows, the residuals of the rows are summed, and the weights brought nearer by what is left of a column in them."""
        left, w = fitted(chosen)
        if left >= UNSURE:
            return left, w, 0.0
        scale = np.sqrt(np.maximum(np.diag(cov)[chosen], 1e-300))
        a = cov[np.ix_(chosen, chosen)] / np.outer(scale, scale)
        for again in (True, False):
            off = F.col(f"c{len(names)}") - float(mean[-1]) - sum((F.lit(float(v)) * (F.col(f"c{k}") - float(mean[k])) for k, v in zip(chosen, w, strict=True)), F.lit(0.0))
            r = rows.withColumn("r", off).agg(F.avg("r").alias("m"), F.var_samp("r").alias("v"), *[F.covar_samp("r", f"c{k}").alias(f"v{k}") for k in chosen]).first()
            if again:
                w = w + np.linalg.lstsq(a, np.array([r[f"v{k}"] for k in chosen]) / scale, rcond=1e-12)[0] / scale
        return float(np.sqrt(max(r.v, 0.0) / cov[-1, -1])), w, float(r.m)

    every = list(range(len(names)))
    whole, _, _ = residual(every)
    verdict = "exact_identity" if whole < exact else "near_identity" if whole < near else "no_identity"
    spare = min((fitted([j for j in every if j != k])[0], names[k]) for k in every)[1] if len(names) > 1 else None
    if verdict == "no_identity":
        return row(verdict, whole, 1 - whole**2, n, spare)
    kept = list(every)
    r = np.abs(cov[:-1, -1]) / np.sqrt(np.maximum(np.diag(cov)[:-1], 1e-300))
    for k in sorted(every, key=lambda k: r[k]):
        trial = [j for j in kept if j != k]
        if trial and residual(trial)[0] <= max(10 * whole, exact):
            kept = trial
    _, w, off = residual(kept)
    return row(verdict, whole, 1 - whole**2, n, spare, [names[k] for k in kept], round(float(mean[-1] - mean[kept] @ w) + off, 6), [round(float(x), 6) for x in w], bool(len(w) > 1 and np.allclose(w, 1, atol=1e-4)))


#: Conventions for quantiles: (alpha, beta) of the linear ones; position n p + alpha + p (1 - alpha - beta).
CONVENTIONS = {"linear": (1, 1), "hazen": (0.5, 0.5), "weibull": (0, 0), "median_unbiased": (1 / 3, 1 / 3), "normal_unbiased": (3 / 8, 3 / 8)}


def quantile_conventions(df: DataFrame, column: str, ps: Sequence[float] = (0.25, 0.5, 0.75), k: float = 1.5) -> DataFrame:
    """(method, q_<p>..., n_outliers): exact quantiles by nine conventions, and how many values lie beyond k interquartile ranges of each one's quartiles (null without both quartiles)."""
    s = ordered_sums(levels(df, finite(column)))
    n = s.agg(F.max("n_all")).first()[0] or 0
    if n < 4:
        return df.sparkSession.createDataFrame([], "method string, " + ", ".join(f"q_{round(p * 100)} double" for p in ps) + ", n_outliers long")
    spots: dict[str, list[tuple[int, int, float]]] = {}
    for name, (a, b) in CONVENTIONS.items():
        spots[name] = []
        for p in ps:
            h = n * p + a + p * (1 - a - b) - 1
            low = math.floor(h)
            spots[name].append((min(max(low, 0), n - 1), min(max(low + 1, 0), n - 1), h - low))
    at = lambda v: min(max(v, 0), n - 1)
    spots["inverted_cdf"] = [(at(math.ceil(n * p) - 1),) * 2 + (0.0,) for p in ps]
    spots["averaged_inverted_cdf"] = [(at(math.ceil(n * p) - 1), at(math.floor(n * p)), 0.5) for p in ps]
    spots["closest_observation"] = [(at(round(n * p) - 1),) * 2 + (0.0,) for p in ps]
    spots["interpolated_inverted_cdf"] = [(at(math.floor(n * p) - 1), at(math.floor(n * p)), n * p - math.floor(n * p)) for p in ps]
    ranks = sorted({r for x in spots.values() for low, high, _ in x for r in (low, high)})
    got = s.agg(*[F.max(F.when((F.col("n_before") <= r) & (F.col("n_before") + F.col("n") > r), F.col("x"))).alias(f"r{r}") for r in ranks]).first()
    rows = [(m, *[got[f"r{low}"] + (got[f"r{high}"] - got[f"r{low}"]) * part for low, high, part in x]) for m, x in spots.items()]
    quarts = (list(ps).index(0.25) + 1, list(ps).index(0.75) + 1) if {0.25, 0.75} <= set(ps) else None
    if quarts:
        bounds = [(x[quarts[0]] - k * (x[quarts[1]] - x[quarts[0]]), x[quarts[1]] + k * (x[quarts[1]] - x[quarts[0]])) for x in rows]
        beyond = s.agg(*[F.sum(F.when((F.col("x") < lo) | (F.col("x") > hi), F.col("n")).otherwise(0)).alias(f"o{i}") for i, (lo, hi) in enumerate(bounds)]).first()
        rows = [(*x, beyond[f"o{i}"]) for i, x in enumerate(rows)]
    else:
        rows = [(*x, None) for x in rows]
    return df.sparkSession.createDataFrame(rows, "method string, " + ", ".join(f"q_{round(p * 100)} double" for p in ps) + ", n_outliers long")


def association(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (measure, value): Spearman's correlation of two numbers of more than two kinds, the correlation ratio of one such number and a category, Cramér's V of two categories."""
    number = {c: isinstance(df.schema[c].dataType, T.NumericType) and df.select(c).where(F.col(c).isNotNull()).distinct().limit(3).count() > 2 for c in (a, b)}
    if number[a] and number[b]:
        return spearman(df, a, b).select(F.lit("spearman").alias("measure"), F.round("rho", 4).alias("value"))
    if number[a] or number[b]:
        category, value = (b, a) if number[a] else (a, b)
        return correlation_ratio(df, category, value).select(F.lit("correlation_ratio").alias("measure"), F.round("eta", 4).alias("value"))
    return cramers_v(df, a, b).select(F.lit("cramers_v").alias("measure"), F.round("v", 4).alias("value"))


def expected_max_noise_correlation(n: int, features: int, sims: int = 400, seed: int = 0) -> tuple[float, float]:
    """(mean, 95th percentile) of the greatest correlation, in size, of that many independent columns of noise with a target over n rows: what a search among them finds by chance."""
    if n < 3 or features < 1:
        return float("nan"), float("nan")
    t = np.random.default_rng(seed).standard_t(n - 2, size=(sims, features))
    top = np.abs(t / np.sqrt(n - 2 + t * t)).max(axis=1)
    return float(top.mean()), float(np.percentile(top, 95))
