"""Features fitted on train and applied elsewhere: states are small DataFrames, so a fit can be saved, read and joined."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import ordered_sums
from .quality import missing
from ..functions.columns import finite, multi_value, normal_cdf


def _all():
    """One window over all rows of a table that is small by then: levels, groups, distinct values."""
    return Window.partitionBy(F.lit(1))


def fold_of(id_col: str, folds: int, seed: int = 42):
    """A row's fold, by the hash of its id: the same on every run."""
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(folds)).cast("int")


def ecdf(train: DataFrame, other: DataFrame, column: str, name: str) -> DataFrame:
    """other with P(X <= x) of train, exactly, from the counted values of both sides."""
    t = train.where(finite(column).isNotNull()).groupBy(finite(column).alias("_x")).agg(F.count("*").alias("_n"))
    o = other.where(finite(column).isNotNull()).select(finite(column).alias("_x"), F.lit(0).cast("long").alias("_n")).distinct()
    steps = ordered_sums(t.unionByName(o).groupBy(F.col("_x").alias("x")).agg(F.sum("_n").alias("n")))
    table = steps.select(F.col("x").alias("_x"), ((F.col("n_before") + F.col("n")) / F.nullif("n_all", F.lit(0))).alias(name))
    return other.join(table, finite(column) == F.col("_x"), "left").drop("_x")


def fit_normal(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, sd); a deviation of 0 counts as 1."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.avg(finite(c)).alias("mean"), F.coalesce(F.nullif(F.stddev_samp(finite(c)), F.lit(0.0)), F.lit(1.0)).alias("sd")) for c in columns])
    return train.agg(rows.alias("r")).select(F.inline("r"))


def apply_normal(state: DataFrame, df: DataFrame, columns: Sequence[str], suffix: str = "_cdf") -> DataFrame:
    one = state.agg(*[F.max(F.when(F.col("column") == c, F.struct("mean", "sd"))).alias(f"_s_{c}") for c in columns])
    return df.crossJoin(one).withColumns({c + suffix: normal_cdf((finite(c) - F.col(f"_s_{c}.mean")) / F.col(f"_s_{c}.sd")) for c in columns}).drop(*one.columns)


def fit_multi_hot(train: DataFrame, column: str) -> DataFrame:
    """(item, n): the vocabulary of a column of written lists."""
    return train.select(F.explode(multi_value(column)).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def apply_multi_hot(vocabulary: Sequence[str], df: DataFrame, column: str, name: str = "cat") -> DataFrame:
    items = multi_value(column)
    out = {f"{name}__{v}": F.array_contains(items, v).cast("int") for v in vocabulary}
    out[f"{name}__count"] = F.size(items)
    out[f"{name}__unknown"] = (F.size(F.array_except(items, F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>"))) > 0).cast("int")
    return df.withColumns(out)


def fit_target(train: DataFrame, category: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """(category, encoded, prior) of the whole train table, smoothed towards the mean."""
    g = train.where(F.col(category).isNotNull()).groupBy(category).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    prior = train.agg(F.avg(target).alias("prior"))
    return g.crossJoin(prior).select(category, ((F.col("_s") + smoothing * F.col("prior")) / (F.col("_n") + smoothing)).alias("encoded"), "prior")


def oof_target_encode(df: DataFrame, category: str, target: str, fold: str, smoothing: float = 10.0, name: str = "encoded") -> DataFrame:
    """df with each row's category encoded from the rows of other folds only. Sums by category and fold are all that is shuffled but the rows' join with them."""
    cell = df.groupBy(category, fold).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    w, f = Window.partitionBy(category), Window.partitionBy(fold)
    cell = cell.withColumns({"_os": F.sum("_s").over(w) - F.col("_s"), "_on": F.sum("_n").over(w) - F.col("_n"), "_fs": F.sum("_s").over(f), "_fn": F.sum("_n").over(f), "_as": F.sum("_s").over(_all()), "_an": F.sum("_n").over(_all())})
    prior = (F.col("_as") - F.col("_fs")) / F.nullif(F.col("_an") - F.col("_fn"), F.lit(0))
    coded = cell.select(F.col(category).alias("_c"), F.col(fold).alias("_f"), ((F.coalesce("_os", F.lit(0)) + smoothing * prior) / (F.col("_on") + smoothing)).alias(name))
    return df.join(coded, F.col(category).eqNullSafe(F.col("_c")) & (F.col(fold) == F.col("_f")), "left").drop("_c", "_f")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(target, n, weight): n / (k n_c)."""
    g = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    return g.select(target, "n", (F.sum("n").over(_all()) / (F.count("*").over(_all()) * F.col("n"))).alias("weight"))


def class_duplicates(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(target, n, n_distinct, duplicate_rate)."""
    one = df.groupBy(target, *columns).agg(F.count("*").alias("_n"))
    return one.groupBy(target).agg(F.sum("_n").alias("n"), F.count("*").alias("n_distinct"), (1 - F.count("*") / F.sum("_n")).alias("duplicate_rate"))


def resample(df: DataFrame, id_col: str, target: str, ratio: float = 1.0, kind: str = "under", seed: int = 42) -> DataFrame:
    """Two classes brought to minority / majority = ratio: "under" keeps the majority's rows of least hash, "over" repeats minority rows, in turn."""
    n = {r[target]: r["count"] for r in df.where(F.col(target).isNotNull()).groupBy(target).count().collect()}
    if len(n) != 2:
        return df
    minor, major = sorted(n, key=lambda k: (n[k], str(k)))
    order = Window.partitionBy(target).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col)
    if kind == "under":
        keep = min(n[major], round(n[minor] / ratio))
        return df.withColumn("_k", F.row_number().over(order)).where((F.col(target) == minor) | (F.col("_k") <= keep)).drop("_k")
    want = max(n[minor], round(n[major] * ratio))
    times = F.when(F.col(target) == minor, F.lit(want // n[minor]) + (F.col("_k") <= want % n[minor]).cast("int")).otherwise(1)
    return df.withColumn("_k", F.row_number().over(order)).withColumn("_r", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).drop("_k", "_r")


def make_split(df: DataFrame, id_col: str, strategy: str = "random", group: str | None = None, time_col: str | None = None, stratify: str | None = None, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """df with split (train or test): random by the hash of the id, group by that of the group, stratified (exact share of each class, in the order of hashes), chronological (the latest share)."""
    share = int(test_size * 1_000_000)
    if strategy in ("random", "group"):
        key = F.xxhash64(group if strategy == "group" else id_col, F.lit(seed))
        return df.withColumn("split", F.when(F.pmod(key, F.lit(1_000_000)) < share, "test").otherwise("train"))
    if strategy == "stratified":
        w = Window.partitionBy(stratify)
        k = F.row_number().over(w.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col))
        return df.withColumn("split", F.when(k <= F.round(F.count("*").over(w) * test_size), "test").otherwise("train"))
    if strategy == "chronological":
        t = F.col(time_col).cast("timestamp").cast("double")
        cut = df.agg(F.percentile(t, F.lit(1 - test_size)).alias("_cut"))
        return df.crossJoin(cut).withColumn("split", F.when(t > F.col("_cut"), "test").otherwise("train")).drop("_cut")
    raise ValueError(f"no strategy {strategy}")


def constant_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """(column, n_unique, variance, flagged)."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.count_distinct(finite(c)).alias("n_unique"), F.var_samp(finite(c)).alias("variance")) for c in columns])
    return df.agg(rows.alias("r")).select(F.inline("r")).withColumn("flagged", (F.col("n_unique") <= 1) | F.coalesce(F.col("variance") <= threshold, F.lit(False)))


def duplicate_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, same_as): columns equal to an earlier one in every row, nulls included; one pass over all pairs."""
    pairs = [(a, b) for j, b in enumerate(columns) for a in columns[:j]]
    rows = F.array(*[F.struct(F.lit(b).alias("column"), F.lit(a).alias("same_as"), F.count_if(~F.col(a).cast("string").eqNullSafe(F.col(b).cast("string"))).alias("n")) for a, b in pairs])
    same = df.agg(rows.alias("r")).select(F.inline("r")).where("n = 0")
    order = F.element_at(F.create_map(*[x for k, c in enumerate(columns) for x in (F.lit(c), F.lit(k))]), F.col("same_as"))
    return same.groupBy("column").agg(F.min_by("same_as", order).alias("same_as"))


def label_mapping(mappings: Mapping[str, Mapping[str, int]], spark) -> DataFrame:
    """(class, n_values, values) where named class-to-index maps disagree or one lacks a class."""
    rows = [(m, c, i) for m, x in mappings.items() for c, i in x.items()]
    t = spark.createDataFrame(rows, "mapping string, class string, i int")
    return t.groupBy("class").agg(F.count_distinct("i").alias("n_values"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("i").cast("string"))), ",").alias("values")).where((F.col("n_values") > 1) | (F.col("n") < len(mappings))).drop("n")


def one_se_rule(results: DataFrame, size: str = "k", score: str = "mean_score", se: str = "se") -> DataFrame:
    """One row: the least size whose score is within a standard error of the best."""
    best = results.agg(F.max_by(F.col(score) - F.col(se), score).alias("_floor"))
    return results.crossJoin(best).where(F.col(score) >= F.col("_floor")).agg(F.min(size).alias("chosen"))


def missing_indicator(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with <column>_isna, 0 or 1, for each column."""
    return df.withColumns({f"{c}_isna": missing(df, c).cast("int") for c in columns})


def availability_audit(features: DataFrame, feature: str, available: str, cutoff) -> DataFrame:
    """(feature, leaky): of features whose values are known from a time on, those that are only known after the cutoff. A feature without a time isn't leaky."""
    return features.select(F.col(feature).alias("feature"), F.coalesce(F.col(available) > F.lit(cutoff), F.lit(False)).alias("leaky"))
