"""Sums, ranks and quantiles in the order of a number, without a task that holds all of it.

Values are first counted (a level is a distinct value with its count). Levels go to buckets by a static rule that keeps their order: sign, octave, and 1024 equal
steps within the octave. The sums of earlier buckets are found over the buckets alone, of which there are at most 1024 for each octave that the values span; the rest is a
window within a bucket. Both the window and the join with the offsets are by bucket, so they share one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEPS = 1024


def bucket_of(x: Column) -> Column:
    """A whole number that never falls as x grows; x is a double and not NaN."""
    size = F.abs(x)
    octave = F.floor(F.log2(size))
    code = (octave + 1100) * STEPS + F.floor((size / F.pow(F.lit(2.0), octave.cast("double")) - 1) * STEPS)
    return F.when(x == 0, F.lit(0).cast("long")).when(size == float("inf"), F.signum(x).cast("long") * (1 << 40)).otherwise(F.signum(x).cast("long") * F.when(size < 2.0**-1000, F.lit(1)).otherwise(code).cast("long"))


def levels(df: DataFrame, value: Column, by: Sequence[str] = (), **sums: Column) -> DataFrame:
    """(by..., x, n, sums...): each distinct value with its count and sums of further columns; nulls are left out."""
    return df.where(value.isNotNull()).groupBy(*by, value.cast("double").alias("x")).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])


def ordered_sums(level: DataFrame, by: Sequence[str] = (), sums: Sequence[str] = ("n",), following: bool = False) -> DataFrame:
    """level (by..., x, ...) with, for each of sums, c_before (its sum over smaller x of the group) and c_all; following: next_x, the next greater value."""
    keyed = level.withColumn("_bucket", bucket_of(F.col("x")))
    key = [*by, "_bucket"]
    totals = keyed.groupBy(*key).agg(*[F.sum(c).alias(f"_{c}_t") for c in sums], F.min("x").alias("_least"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*key, *[F.coalesce(F.sum(f"_{c}_t").over(before), F.lit(0)).alias(f"_{c}_o") for c in sums], *[F.sum(f"_{c}_t").over(group).alias(f"{c}_all") for c in sums], F.lead("_least").over(group.orderBy("_bucket")).alias("_next"))
    inside = Window.partitionBy(*key).orderBy("x")
    run = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.withColumns({f"_{c}_r": F.coalesce(F.sum(c).over(run), F.lit(0)) for c in sums} | ({"_lead": F.lead("x").over(inside)} if following else {}))
    # groups may be null
    renamed = offsets.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], *[c for c in offsets.columns if c not in key])
    met = None
    for i, c in enumerate(key):
        same = F.col(c).eqNullSafe(F.col(f"_k{i}"))
        met = same if met is None else met & same
    out = out.join(renamed, met).withColumns({f"{c}_before": F.col(f"_{c}_o") + F.col(f"_{c}_r") for c in sums} | ({"next_x": F.coalesce("_lead", "_next")} if following else {}))
    return out.select(*level.columns, *[f"{c}_{k}" for c in sums for k in ("before", "all")], *(["next_x"] if following else []))


def ordered_extreme(level: DataFrame, column: str, name: str, how: str = "max", descending: bool = False) -> DataFrame:
    """level (x, ...) with the greatest ("max") or least ("min") value of column over all x up to and with this one, or from this one on (descending)."""
    f, pick = (F.max, F.greatest) if how == "max" else (F.min, F.least)
    keyed = level.withColumn("_bucket", bucket_of(F.col("x")))
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    before = Window.partitionBy(F.lit(1)).orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("_bucket").agg(f(column).alias("_t")).select(F.col("_bucket").alias("_b"), f("_t").over(before).alias("_o"))
    run = Window.partitionBy("_bucket").orderBy(order("x")).rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.withColumn("_r", f(column).over(run)).join(offsets, F.col("_bucket") == F.col("_b"))
    # greatest and least pass over a null, as there is for the first bucket
    return out.withColumn(name, pick("_r", "_o")).select(*level.columns, name)


def quantile_columns(ps: Sequence[float], names: Sequence[str]) -> list[Column]:
    """Aggregates over ordered_sums: quantiles between the two nearest ranks, as of a sorted list."""
    out = []
    for p, name in zip(ps, names, strict=True):
        h = (F.col("n_all") - 1) * F.lit(float(p))
        at = lambda k: F.max(F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")), F.col("x")))
        low, high, part = at(F.floor(h)), at(F.ceil(h)), F.max(h - F.floor(h))
        out.append((low + (high - low) * part).alias(name))
    return out


def quantiles(df: DataFrame, value: Column, ps: Sequence[float], names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., names...): exact quantiles of a number; one row of nulls where there are no values and no groups."""
    return ordered_sums(levels(df, value, by), by).groupBy(*by).agg(*quantile_columns(ps, names))
