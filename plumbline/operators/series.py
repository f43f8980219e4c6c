"""Ordered data: lags, rolling and expanding statistics, grids, forecasts and their errors. Every operator takes its order."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "median": F.median}


def _w(group: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*group).orderBy(*order)


def add_lags(df: DataFrame, col: str, lags: Sequence[int], order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({f"{col}_lag{k}": F.lag(col, k).over(_w(group, order)) for k in lags})


def add_difference(df: DataFrame, col: str, order: Sequence[str], periods: Sequence[int] = (1,), group: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({f"{col}_diff{k}": F.col(col) - F.lag(col, k).over(_w(group, order)) for k in periods})


def add_rolling(df: DataFrame, col: str, windows: Sequence[int], order: Sequence[str], funcs: Sequence[str] = ("mean", "std"), group: Sequence[str] = (), shift: int = 1) -> DataFrame:
    """Over the previous w rows, the own row only with shift 0; null until the window has w values."""
    out = {}
    for n in windows:
        w = _w(group, order).rowsBetween(-n - shift + 1, -shift)
        for f in funcs:
            out[f"{col}_roll{n}_{f}"] = F.when(F.count(col).over(w) >= n, STATS[f](col).over(w))
    return df.withColumns(out)


def add_expanding(df: DataFrame, col: str, order: Sequence[str], func: str = "mean", group: Sequence[str] = (), shift: int = 1) -> DataFrame:
    """Over all rows up to `shift` before."""
    return df.withColumn(f"{col}_expanding_{func}", STATS[func](col).over(_w(group, order).rowsBetween(Window.unboundedPreceding, -shift)))


def add_ewm(df: DataFrame, col: str, spans: Sequence[int], order: Sequence[str], group: Sequence[str] = (), shift: int = 1, terms: int = 0) -> DataFrame:
    """Exponentially weighted mean of the rows up to `shift` before. Weights below 1e-12 of the greatest are left out, which bounds the window (terms overrides it). Nulls keep their place and have no weight."""
    return df.withColumns({f"{col}_ewm{span}": _weighted(col, 1 - 2 / (span + 1), order, group, shift, terms) for span in spans})


def _weighted(col: str, keep: float, order: Sequence[str], group: Sequence[str], shift: int, terms: int) -> Column:
    n = terms or (max(1, math.ceil(math.log(1e-12) / math.log(keep))) if keep > 0 else 1)
    w = _w(group, order).rowsBetween(-n - shift + 1, -shift)
    # collect_list passes over nulls, so each value travels in a struct
    past = F.reverse(F.collect_list(F.struct(F.col(col).cast("double").alias("v"))).over(w))
    parts = F.transform(past, lambda x, i: F.struct((F.pow(F.lit(keep), i) * x["v"]).alias("a"), F.when(x["v"].isNotNull(), F.pow(F.lit(keep), i)).alias("b")))
    add = lambda field: F.aggregate(parts, F.lit(0.0), lambda s, x: s + F.coalesce(x[field], F.lit(0.0)))
    return F.try_divide(add("a"), add("b"))


def add_calendar(df: DataFrame, at: str, cyclical: bool = True) -> DataFrame:
    """Year, month, day of week (Monday 0), hour, and sines and cosines of month and day of week."""
    t = F.col(at)
    out = {f"{at}_year": F.year(t), f"{at}_month": F.month(t), f"{at}_dow": F.weekday(t), f"{at}_hour": F.hour(t)}
    if cyclical:
        for name, part, period in (("month", F.month(t), 12), ("dow", F.weekday(t), 7)):
            out |= {f"{at}_{name}_sin": F.sin(2 * math.pi * part / period), f"{at}_{name}_cos": F.cos(2 * math.pi * part / period)}
    return df.withColumns(out)


def add_fourier(df: DataFrame, index: str, period: float, order: int = 3, prefix: str = "fourier") -> DataFrame:
    turn = lambda k: 2 * math.pi * k * F.col(index) / period
    return df.withColumns({f"{prefix}_{f}{k}": (F.sin if f == "sin" else F.cos)(turn(k)) for k in range(1, order + 1) for f in ("sin", "cos")})


def sliding_days(df: DataFrame, key: Sequence[str], day: str, value: str, days: int, name: str) -> DataFrame:
    """Sum of value over the last `days` calendar days, the own one included."""
    n = F.unix_date(F.col(day).cast("date"))
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*key).orderBy(n).rangeBetween(-days + 1, 0)))


def acf(df: DataFrame, col: str, order: Sequence[str], nlags: int = 20, group: Sequence[str] = ()) -> DataFrame:
    """(group..., lag, r): autocorrelation with the biased denominator; null for a constant series."""
    w = _w(group, order)
    centred = df.where(F.col(col).isNotNull()).select(*group, *order, (F.col(col) - F.avg(col).over(Window.partitionBy(*group))).alias("_d"))
    shifted = centred.select(*group, "_d", *[F.lag("_d", k).over(w).alias(f"_d{k}") for k in range(1, nlags + 1)])
    whole = F.nullif(F.sum(F.col("_d") * F.col("_d")), F.lit(0.0))
    entries = F.array(*[F.struct(F.lit(k).alias("lag"), (F.coalesce(F.sum(F.col("_d") * F.col(f"_d{k}" if k else "_d")), F.lit(0.0)) / whole).alias("r")) for k in range(nlags + 1)])
    return shifted.groupBy(*group).agg(entries.alias("e")).select(*group, F.explode("e").alias("e")).select(*group, "e.lag", "e.r")


def pacf(df: DataFrame, col: str, order: Sequence[str], nlags: int = 20) -> list[float]:
    """Partial autocorrelations of one series, by the Levinson-Durbin recursion over its autocorrelations."""
    r = [x.r for x in acf(df, col, order, nlags).orderBy("lag").collect()]
    if any(x is None for x in r):
        return []
    out, phi = [1.0], np.zeros(0)
    for k in range(1, nlags + 1):
        rest = 1 - sum(phi * np.array(r[1:k]))
        last = (r[k] - sum(phi * np.array(r[1:k][::-1]))) / rest if rest > 1e-12 else float("nan")
        phi = np.append(phi - last * phi[::-1], last)
        out.append(float(last))
    return out


def frac_diff_weights(d: float, threshold: float = 1e-4, most: int = 10_000) -> list[float]:
    """Binomial weights of (1 - L)^d down to the threshold."""
    out = [1.0]
    while len(out) < most:
        w = -out[-1] * (d - len(out) + 1) / len(out)
        if abs(w) < threshold:
            break
        out.append(w)
    return out


def frac_diff(df: DataFrame, col: str, d: float, order: Sequence[str], group: Sequence[str] = (), threshold: float = 1e-4) -> DataFrame:
    """Fractional difference of fixed width; null where a value of the window is missing."""
    weights = frac_diff_weights(d, threshold)
    w = _w(group, order).rowsBetween(-len(weights) + 1, 0)
    past = F.reverse(F.collect_list(F.col(col).cast("double")).over(w))
    value = F.aggregate(F.zip_with(past, F.array(*map(F.lit, weights)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(f"{col}_fd", F.when(F.count(col).over(w) == len(weights), value))


def to_regular_grid(df: DataFrame, at: str, every: str, values: Sequence[str], group: Sequence[str] = (), fill: str | None = "ffill") -> DataFrame:
    """A row for each step of `every` (an interval) from a group's first time to its last; values of that time, else of the last before (ffill) or null. Of rows of one time the one of least values counts."""
    one = df.where(F.col(at).isNotNull()).groupBy(*group, at).agg(F.min(F.struct(*values)).alias("_v"))
    spans = one.groupBy(*group).agg(F.min(at).alias("_a"), F.max(at).alias("_z"))
    grid = spans.select(*group, F.explode(F.sequence("_a", "_z", F.expr(f"INTERVAL {every}"))).alias(at))
    if fill is None:
        return grid.join(one, [*group, at], "left").select(*group, at, *[F.col(f"_v.{v}").alias(v) for v in values])
    # times off the grid still tell what was last known
    both = grid.withColumn("_on", F.lit(1)).join(one, [*group, at], "full_outer")
    w = _w(group, [at]).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({v: F.last(F.col(f"_v.{v}"), ignorenulls=True).over(w) for v in values})
    return both.where("_on = 1").select(*group, at, *values)


def naive_forecast(df: DataFrame, col: str, index: str, horizon: int, season: int = 1, group: Sequence[str] = ()) -> DataFrame:
    """(group..., step, forecast): the last season, repeated."""
    last = df.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(index).desc()))).where(F.col("_k") <= season)
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).where(F.pmod(F.col("step") - 1, F.lit(season)) == season - F.col("_k"))
    return steps.select(*group, "step", F.col(col).alias("forecast"))


def scaled_errors(test: DataFrame, train: DataFrame, y: str, pred: str, index: str, season: int = 1, group: Sequence[str] = ()) -> DataFrame:
    """(group..., mase, rmsse): errors over those of the seasonal naive forecast within train; null where that never errs."""
    gap = train.withColumn("_e", F.col(y) - F.lag(y, season).over(_w(group, [index])))
    base = gap.groupBy(*group).agg(F.nullif(F.avg(F.abs("_e")), F.lit(0.0)).alias("_a"), F.nullif(F.avg(F.col("_e") * F.col("_e")), F.lit(0.0)).alias("_s"))
    e = F.col(y) - F.col(pred)
    own = test.groupBy(*group).agg(F.avg(F.abs(e)).alias("_ma"), F.avg(e * e).alias("_ms"))
    both = own.join(base, list(group)) if group else own.crossJoin(base)
    return both.select(*group, (F.col("_ma") / F.col("_a")).alias("mase"), F.sqrt(F.col("_ms") / F.col("_s")).alias("rmsse"))


def half_split(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """(half, n, mean, std) of the earlier and the later half of a series: where they differ, it isn't stationary."""
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    halves = df.where(F.col(col).isNotNull()).withColumn("half", F.when(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) <= F.floor(n / 2), 1).otherwise(2))
    return halves.groupBy("half").agg(F.count("*").alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"))


def purge_and_embargo(train: DataFrame, at: str, low, high, horizon: float, embargo: float | None = None) -> DataFrame:
    """Rows of train (times as numbers) whose label span doesn't reach into the test's [low, high] and that don't follow it within the embargo, which is the horizon if it isn't given."""
    purged, held = _purged(at, low, high, horizon, embargo)
    return train.where(F.coalesce(~(purged | held), F.lit(True)))


def purge_report(train: DataFrame, at: str, low, high, horizon: float, embargo: float | None = None) -> DataFrame:
    """One row (n_train_before, n_purged, n_embargoed, n_train_after, fraction_dropped)."""
    purged, held = _purged(at, low, high, horizon, embargo)
    a = train.agg(F.count("*").alias("n_train_before"), F.count_if(purged).alias("n_purged"), F.count_if(held).alias("n_embargoed"))
    dropped = F.col("n_purged") + F.col("n_embargoed")
    return a.withColumns({"n_train_after": F.col("n_train_before") - dropped, "fraction_dropped": F.try_divide(dropped, F.col("n_train_before"))})


def _purged(at: str, low, high, horizon: float, embargo: float | None):
    h = max(horizon, 0)
    e = h if embargo is None else max(embargo, 0)
    return (F.col(at) + h >= low) & (F.col(at) < low), (F.col(at) > high) & (F.col(at) <= F.lit(high) + e)


def percent_change(df: DataFrame, col: str, lag: int, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """df with <col>_pct<lag>: the change against the value `lag` rows before, relative to it; null where that is missing or 0."""
    before = F.lag(col, lag).over(_w(group, order))
    return df.withColumn(f"{col}_pct{lag}", F.try_divide(F.col(col) - before, before))


def reversed_column(df: DataFrame, col: str, order: Sequence[str], group: Sequence[str]) -> DataFrame:
    """df with <col>_reversed: the value of the row of mirrored rank in its group; order has to tell a group's rows apart."""
    w = _w(group, order)
    ranked = df.withColumn("_r", F.row_number().over(w)).withColumn("_m", F.count("*").over(Window.partitionBy(*group)) + 1 - F.col("_r"))
    other = ranked.select(*group, F.col("_m").alias("_r"), F.col(col).alias(f"{col}_reversed"))
    return ranked.drop("_m").join(other, [*group, "_r"]).drop("_r")


def weighted_errors(df: DataFrame, rmsse: str, weight: str) -> DataFrame:
    """One row (wrmsse): errors of several series, weighted by their share."""
    return df.agg(F.try_divide(F.sum(F.col(rmsse) * F.col(weight)), F.sum(weight)).alias("wrmsse"))


def share_of_gap(x: Column, y: Column) -> Column:
    return F.try_divide(F.abs(x - y), F.abs(x))
