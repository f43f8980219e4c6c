"""Data-quality audit: profiles, missingness, duplicates, conflicts, outliers, shifts. Each takes one or two passes over all columns together."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import MOJIBAKE, NUMERIC_SENTINELS, SENTINELS, finite, normal_label
from ..functions.distributions import chi2_tail, kolmogorov_tail, normal_quantile
from ..functions.ordering import levels, ordered_sums, quantile_columns, quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _long(df: DataFrame, columns: Sequence[str], make) -> DataFrame:
    """One aggregation; make(column) gives the named measures of a row of the result."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[v.alias(k) for k, v in make(c).items()]) for c in columns])
    return df.agg(rows.alias("_r")).select(F.inline("_r"))


def missing(df: DataFrame, c: str) -> Column:
    """Whether a value is missing: null or NaN. An infinity isn't."""
    kind = df.schema[c].dataType
    return F.col(c).isNull() | (F.isnan(c) if isinstance(kind, T.FloatType | T.DoubleType) else F.lit(False))


def _infinite(df: DataFrame, c: str) -> Column:
    return F.count_if(F.abs(F.col(c)) == float("inf")) if isinstance(df.schema[c].dataType, T.FloatType | T.DoubleType) else F.lit(0).cast("long")


_NUMBER = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(inf|infinity))\s*$"
_TIMES = ["M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "d.M.yyyy", "d-M-yyyy", "yyyy.M.d"]


def _is_time(s: Column) -> Column:
    return F.coalesce(s.try_cast("timestamp"), *[F.try_to_timestamp(s, F.lit(f)) for f in _TIMES]).isNotNull()


def _column_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_unique, n, top, n_low): of each column's values as text: how many there are, how often the most frequent one occurs, how many are left without case and outer blanks.

    One exchange of counted values for all columns, instead of a distinct count for each."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.when(~missing(df, c), F.col(c).cast("string")).alias("level")) for c in columns])
    counted = df.select(F.explode(entries).alias("e")).select("e.*").where("level IS NOT NULL").groupBy("column", "level").agg(F.count("*").alias("n"))
    low = counted.groupBy("column", F.lower(F.regexp_replace("level", r"(?U)^\s+|\s+$", "")).alias("low")).agg(F.count("*").alias("n_unique"), F.sum("n").alias("n"), F.max("n").alias("top"))
    return low.groupBy("column").agg(F.sum("n_unique").alias("n_unique"), F.sum("n").alias("n"), F.max("top").alias("top"), F.count("*").alias("n_low"))


def _measures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, ...): what one pass over all columns tells for roles and issues."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def make(c: str) -> dict[str, Column]:
        k, there = kinds[c], ~missing(df, c)
        text = F.when(there, F.col(c)) if isinstance(k, T.StringType) else F.lit(None).cast("string")
        number = F.when(there, F.col(c).cast("double")) if isinstance(k, T.NumericType) else F.lit(None).cast("double")
        share = lambda x: F.avg(x.cast("int"))
        trimmed = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
        return {
            "dtype": F.lit(k.simpleString()),
            "rows": F.count("*"),
            "there": F.count_if(there),
            "n_inf": _infinite(df, c),
            "example": F.min(F.when(there, F.col(c).cast("string"))),
            "least": F.min(number),
            "dated": share(text.rlike(r"\d{1,4}[-/.:]\d")),
            "times": share(F.when(text.rlike(r"\d{1,4}[-/.:]\d"), _is_time(text)).otherwise(F.when(text.isNotNull(), F.lit(False)))),
            "listed": F.greatest(share(text.rlike("[;,|]")), share(text.rlike(r"^\s*[\(\[].*[\)\]]\s*$"))),
            "length": F.avg(F.length(text)),
            "sentinels": F.count_if(trimmed.isin(SENTINELS)),
            "numbers": share(F.lower(text).rlike(_NUMBER)),
            "broken": F.count_if(text.rlike("|".join(MOJIBAKE))),
            "feeds": F.count_if(text.rlike(r"[\r\n\t]")),
            "codes": F.array_join(F.array_compact(F.array(*[F.when(F.count_if(number == v) > 0, F.lit(str(v))) for v in NUMERIC_SENTINELS])), ", "),
        }

    return _long(df, columns, make)


def profile_schema(df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None, id_columns: Sequence[str] = (), dominant: float = 0.5) -> DataFrame:
    """(column, role, dtype, n_missing, missing_rate, n_inf, n_unique, example, issues): role is the first that fits.

    empty; datetime; binary (two values at most); of numbers: identifier (named so, or whole and over 98 % distinct), count (whole, from 0, fewer than 100 kinds), continuous;
    of text: datetime_text (most look like dates and over 90 % read as such), multi_label_or_list, free_text (long, or mostly distinct and not short), nominal. The target's role is named target/role.
    example is the least value as text; issues are those of detect_issues, joined by commas."""
    columns = list(columns or df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    of = lambda kind: F.col("column").isin([c for c in columns if isinstance(kinds[c], kind)])
    m = _measures(df, columns).join(_column_levels(df, columns).drop("n"), "column", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
    unique = F.try_divide("n_unique", F.col("there"))
    whole = of(T.IntegralType)
    role = (
        F.when(F.col("there") == 0, "empty")
        .when(of(T.DateType | T.TimestampType | T.TimestampNTZType), "datetime")
        .when((F.col("n_unique") <= 2) | of(T.BooleanType), "binary")
        .when(of(T.NumericType) & (F.col("column").isin(list(id_columns)) | (whole & (unique > 0.98))), "identifier")
        .when(whole & (F.col("least") >= 0) & (F.col("n_unique") < 100), "count")
        .when(of(T.NumericType), "continuous")
        .when((F.col("dated") > 0.5) & (F.col("times") > 0.9), "datetime_text")
        .when(F.col("listed") > 0.3, "multi_label_or_list")
        .when((F.col("length") > 40) | ((unique > 0.8) & (F.col("length") > 15)), "free_text")
        .otherwise("nominal")
    )
    named = F.when(F.col("column") == target, F.concat(F.lit("target/"), role)).otherwise(role) if target else role
    lost = F.col("rows") - F.col("there")
    return m.select("column", named.alias("role"), "dtype", lost.alias("n_missing"), F.coalesce(F.round(F.try_divide(lost, F.col("rows")), 4), F.lit(0.0)).alias("missing_rate"), "n_inf", "n_unique", "example", F.array_join(_issues(columns, kinds, dominant), ",").alias("issues"))


def _issues(columns: Sequence[str], kinds, dominant: float) -> Column:
    """Array of the issues of a row of _measures with _column_levels."""
    of = lambda kind: F.col("column").isin([c for c in columns if isinstance(kinds[c], kind)])
    share = F.try_divide("top", F.col("there"))
    text = of(T.StringType)
    found = [
        (F.col("n_inf") > 0, F.concat(F.lit("non_finite_values:"), F.col("n_inf").cast("string"))),
        (F.col("n_unique") == 1, F.lit("constant_value")),
        ((F.col("n_unique") > 1) & (F.col("there") >= 10) & (share >= dominant), F.concat(F.lit("dominant_value_share:"), F.round(share, 3).cast("string"))),
        (text & (F.col("sentinels") > 0), F.lit("string_sentinels")),
        (text & (F.col("numbers") > 0.95), F.lit("numeric_stored_as_text")),
        (text & (F.col("n_low") < F.col("n_unique")), F.lit("case_or_whitespace_variants")),
        (text & (F.col("broken") > 0), F.lit("encoding_artifacts")),
        (text & (F.col("feeds") > 0), F.lit("embedded_newlines_or_tabs")),
        (F.col("codes") != "", F.concat(F.lit("possible_numeric_sentinels:["), "codes", F.lit("]"))),
        (of(T.IntegralType) & (F.col("n_unique") <= 15) & (F.col("least") >= 0), F.lit("integer_may_be_category_code")),
    ]
    return F.when(F.col("there") == 0, F.array(F.lit("all_missing"))).otherwise(F.array_compact(F.array(*[F.when(c, v) for c, v in found])))


def missingness_summary(df: DataFrame, columns: Sequence[str] | None = None, by: str | None = None) -> DataFrame:
    """(column, missing_rate), or (by, column, missing_rate) without the slice of null."""
    columns = [c for c in (columns or df.columns) if c != by]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.avg(missing(df, c).cast("int")).alias("missing_rate")) for c in columns])
    if by is None:
        return df.agg(rows.alias("_r")).select(F.inline("_r"))
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(rows.alias("_r")).select(by, F.inline("_r"))


def co_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) of every two columns a < b: correlation of their missing flags; null where one has none or only missing values."""
    flags = df.select(*[missing(df, c).cast("double").alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return flags.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("_r")).select(F.inline("_r")).withColumn("r", F.nanvl("r", F.lit(None).cast("double")))


def missingness_vs_target(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    y = F.col(target).cast("double")
    out = _long(df, columns, lambda c: {"when_missing": F.avg(F.when(missing(df, c), y)), "when_present": F.avg(F.when(~missing(df, c), y))})
    return out.withColumn("gap", F.col("when_missing") - F.col("when_present"))


def impute(train: DataFrame, columns: Sequence[str], how: str = "median") -> DataFrame:
    """One row of each column's mean or median, fitted on train; fill_from applies it."""
    if how == "mean":
        return train.agg(*[F.avg(finite(c)).alias(c) for c in columns])
    if how != "median":
        raise KeyError(how)
    # from counted values: no task holds a column
    m = ordered_sums(_stacked(train, columns), ["column"]).groupBy("column").agg(*quantile_columns([0.5], ["m"]))
    return m.agg(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(c) for c in columns])


def fill_from(df: DataFrame, state: DataFrame) -> DataFrame:
    cols = state.columns
    one = state.select(*[F.col(c).alias(f"_fill_{c}") for c in cols])
    return df.crossJoin(one).withColumns({c: F.when(missing(df, c), F.col(f"_fill_{c}")).otherwise(F.col(c)) for c in cols}).drop(*one.columns)


def imputation_probe(df: DataFrame, id_col: str, column: str, how: str = "median", frac: float = 0.1, seed: int = 42) -> DataFrame:
    """One row: mean absolute error of imputing values that were there, hidden by the hash of their id, and the same over the mean absolute deviation."""
    x = df.where(~missing(df, column)).select(F.col(column).cast("double").alias("x"), (F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(10_000)) < int(frac * 10_000)).alias("hidden"))
    state = impute(x.where("NOT hidden"), ["x"], how).select(F.col("x").alias("fill"))
    return x.where("hidden").crossJoin(state).agg(F.count("*").alias("n_hidden"), F.avg(F.abs(F.col("x") - F.col("fill"))).alias("mae"), F.try_divide(F.avg(F.abs(F.col("x") - F.col("fill"))), F.stddev_pop("x")).alias("mae_over_sd"))


def lowrank_impute(df: DataFrame, columns: Sequence[str], components: int = 1, most: int = 100, tol: float = 1e-6) -> tuple[DataFrame, list[float]]:
    """(df with the missing values of columns filled from its principal components, the objective of each round). Columns are standardised; missing values begin at the mean and are replaced by the low-rank form until the misfit of the values
    that are there no longer falls by tol.

    A round is one pass that sums columns by columns. What a row's missing values have become follows from the row and the components of the rounds before, so no state is kept by row."""
    columns = list(columns)
    a = df.agg(*[f(finite(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([a[f"m{i}"] or 0.0 for i in range(len(columns))])
    sd = np.array([a[f"s{i}"] or 1.0 for i in range(len(columns))])
    slim, bases = df.select(*[finite(c).alias(c) for c in columns]), []

    def replay(x: np.ndarray) -> tuple[np.ndarray, float]:
        gone = np.isnan(x)
        z, misfit = np.where(gone, 0.0, (x - mean) / sd), 0.0
        for v in bases:
            low = z @ v @ v.T
            z = np.where(gone, low, z)
            misfit = float(((z - low)[~gone] ** 2).sum())
        return z, misfit

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(columns))], axis=1)

    def gram(batches):
        total, misfit = np.zeros((len(columns), len(columns))), 0.0
        for b in batches:
            z, m = replay(matrix(b))
            total, misfit = total + z.T @ z, misfit + m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([misfit])], names=["g", "m"])

    objective: list[float] = []
    while True:
        sums = slim.mapInArrow(gram, "g binary, m double").collect()  # a row a task
        if bases:
            objective.append(round(sum(r.m for r in sums), 6))
            if len(bases) >= most or (len(objective) > 1 and objective[-2] - objective[-1] < tol * max(objective[-2], 1e-12)):
                break
        g = sum(np.frombuffer(r.g).reshape(len(columns), -1) for r in sums)
        bases.append(np.linalg.eigh(g)[1][:, ::-1][:, :components])

    names, at = df.columns, [df.columns.index(c) for c in columns]

    def fill(batches):
        for b in batches:
            x = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in at], axis=1)
            z, _ = replay(np.where(np.isfinite(x), x, np.nan))
            out = list(b.columns)
            for j, k in enumerate(at):
                out[k] = pa.array(np.where(np.isfinite(x[:, j]), x[:, j], z[:, j] * sd[j] + mean[j]))
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = ", ".join(f"`{f.name}` {'double' if f.name in columns else f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(fill, schema), objective


def iqr_flags(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """df with is_outlier: beyond k interquartile ranges of the quartiles; a missing value isn't one."""
    q = quantiles(df, finite(column), [0.25, 0.75], ["_a", "_z"])
    lo, hi = F.col("_a") - k * (F.col("_z") - F.col("_a")), F.col("_z") + k * (F.col("_z") - F.col("_a"))
    # NaN is above everything in Spark
    x = F.when(~missing(df, column), F.col(column))
    return df.crossJoin(q).withColumn("is_outlier", F.coalesce((x < lo) | (x > hi), F.lit(False))).drop("_a", "_z")


def _median_and_mad(level: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., _m, _d): median and median absolute deviation, from levels (by..., x, n)."""
    med = ordered_sums(level, by).groupBy(*by).agg(*quantile_columns([0.5], ["_m"]))
    # a row a group or a column: a join by these few keys would send each key's rows to one task
    near = level.join(F.broadcast(med), list(by)) if by else level.crossJoin(med)
    away = near.groupBy(*by, "_m", F.abs(F.col("x") - F.col("_m")).alias("x")).agg(F.sum("n").alias("n"))
    return ordered_sums(away, [*by, "_m"]).groupBy(*by, "_m").agg(*quantile_columns([0.5], ["_d"]))


def robust_z_flags(df: DataFrame, column: str, thresh: float = 3.5) -> DataFrame:
    """df with is_outlier: 0.6745 (x - median) / MAD beyond thresh; none where the MAD is 0."""
    one = _median_and_mad(levels(df, finite(column))).agg(F.max("_m").alias("_m"), F.max("_d").alias("_d"))
    z = F.try_divide(0.6745 * (F.when(~missing(df, column), F.col(column)) - F.col("_m")), F.col("_d"))
    return df.crossJoin(one).withColumn("is_outlier", F.coalesce(F.abs(z) > thresh, F.lit(False))).drop("_m", "_d")


def domain_flags(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    x = F.when(~missing(df, column), F.col(column))
    bad = (x < F.lit(low)) if low is not None else F.lit(False)
    bad = bad | (x > F.lit(high)) if high is not None else bad
    return df.withColumn("out_of_domain", F.coalesce(bad, F.lit(False)))


def _stacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, x, n): the counted values of all columns."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("v")) for c in columns])).alias("e")).select("e.*")
    return levels(each, F.col("v"), ["column"])


def univariate_report(df: DataFrame, columns: Sequence[str], k: float = 1.5, thresh: float = 3.5) -> DataFrame:
    """(column, n_iqr, n_robust_z), from one count of the values of all columns."""
    level = _stacked(df, columns)
    q = ordered_sums(level, ["column"]).groupBy("column").agg(*quantile_columns([0.25, 0.75], ["_a", "_z"]))
    x = level.join(F.broadcast(q), "column").join(F.broadcast(_median_and_mad(level, ["column"])), "column")  # a row a column
    spread = F.col("_z") - F.col("_a")
    out = x.groupBy("column").agg(F.sum(F.when((F.col("x") < F.col("_a") - k * spread) | (F.col("x") > F.col("_z") + k * spread), F.col("n")).otherwise(0)).alias("n_iqr"), F.sum(F.when(F.abs(F.try_divide(0.6745 * (F.col("x") - F.col("_m")), F.col("_d"))) > thresh, F.col("n")).otherwise(0)).alias("n_robust_z"))
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return named.join(out, "column", "left").na.fill(0)


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n, missing_rate, n_unique, least, q01, median, mean, q99, greatest, std, iqr, mad, skew, kurtosis, zero_frac); moments of the population, kurtosis in excess.

    Moments take one pass over all columns; distinct values are counted once for all columns, and quantiles come from these counts."""
    columns = list(columns or numeric_columns(df))

    def make(c: str) -> dict[str, Column]:
        x = finite(c)
        return {"n": F.count(x), "missing_rate": F.avg(missing(df, c).cast("int")), "least": F.min(x), "mean": F.avg(x), "greatest": F.max(x), "std": F.stddev_samp(x), "skew": F.when(F.count(x) > 2, F.skewness(x)), "kurtosis": F.when(F.count(x) > 3, F.kurtosis(x)), "zero_frac": F.avg((x == 0).cast("int"))}

    level = _stacked(df, columns)
    q = ordered_sums(level, ["column"]).groupBy("column").agg(F.count("*").alias("n_unique"), *quantile_columns([0.01, 0.25, 0.5, 0.75, 0.99], ["q01", "_a", "median", "_z", "q99"]))
    mad = _median_and_mad(level, ["column"]).select("column", F.col("_d").alias("mad"))
    out = _long(df, columns, make).join(q, "column", "left").join(mad, "column", "left").withColumn("iqr", F.col("_z") - F.col("_a")).withColumn("n_unique", F.coalesce("n_unique", F.lit(0).cast("long")))
    return out.select("column", "n", "missing_rate", "n_unique", "least", "q01", "median", "mean", "q99", "greatest", "std", "iqr", "mad", "skew", "kurtosis", "zero_frac")


def categorical_summary(df: DataFrame, columns: Sequence[str], rare: float = 0.01) -> DataFrame:
    """(column, cardinality, top, top_share, entropy, gini, n_rare): one exchange for all columns; ties for the top go to the least level."""
    levels = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])).alias("e")).select("e.*").where("level IS NOT NULL")
    n = levels.groupBy("column", "level").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("column")))
    return p.groupBy("column").agg(F.count("*").alias("cardinality"), F.min_by("level", F.struct(-F.col("n"), F.col("level"))).alias("top"), F.max("p").alias("top_share"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), (1 - F.sum(F.col("p") * F.col("p"))).alias("gini"), F.count_if(F.col("p") < rare).alias("n_rare"))


def detect_issues(df: DataFrame, columns: Sequence[str] | None = None, dominant: float = 0.5) -> DataFrame:
    """(column, issue): all_missing; or non_finite_values:n, constant_value, dominant_value_share:s (of 10 values at least), possible_numeric_sentinels:[...], integer_may_be_category_code, and of text string_sentinels,
    numeric_stored_as_text (over 95 %), case_or_whitespace_variants, encoding_artifacts, embedded_newlines_or_tabs."""
    columns = list(columns or df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    m = _measures(df, columns).join(_column_levels(df, columns).drop("n"), "column", "left")
    return m.select("column", F.explode(_issues(columns, kinds, dominant)).alias("issue"))


def label_variants(df: DataFrame, column: str, cutoff: float = 0.82, least: int = 4, most_levels: int = 400) -> DataFrame:
    """(a, b, reason, similarity): levels that read alike. Equal after normalising: all levels. Similar spelling (1 - distance / length of the longer): keys of at least `least` characters, among the most_levels most
    frequent ones; the keys beyond that are named, with the reason not_compared and no partner."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n")).withColumn("key", normal_label("level"))
    a, b = counted.select(F.col("level").alias("a"), "key"), counted.select(F.col("level").alias("b"), "key")
    equal = a.join(b, "key").where("a < b").select("a", "b", F.lit("normalized").alias("reason"), F.lit(1.0).alias("similarity"))
    keys = counted.groupBy("key").agg(F.sum("n").alias("n"), F.min("level").alias("level")).where(F.length("key") >= least)
    first = keys.orderBy(F.desc("n"), "key").limit(most_levels)
    x, y = first.select(F.col("key").alias("ka"), F.col("level").alias("a")), first.select(F.col("key").alias("kb"), F.col("level").alias("b"))
    similarity = 1 - F.levenshtein("ka", "kb") / F.greatest(F.length("ka"), F.length("kb"))
    fuzzy = x.join(y, F.col("a") < F.col("b")).withColumn("similarity", similarity).where(F.col("similarity") >= cutoff).select("a", "b", F.lit("fuzzy").alias("reason"), "similarity")
    rest = keys.join(first.select("key"), "key", "left_anti").select(F.col("level").alias("a"), F.lit(None).cast("string").alias("b"), F.lit("not_compared").alias("reason"), F.lit(None).cast("double").alias("similarity"))
    return equal.unionByName(fuzzy).unionByName(rest)


def key_conflicts(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], examples: int = 5) -> DataFrame:
    """(keys..., attribute, n_rows, n_distinct, examples) where an attribute has several values for a key; a null key is a key."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("v")) for a in attributes])).alias("e")).select(*keys, "e.*")
    each = long.where("v IS NOT NULL").groupBy(*keys, "attribute", "v").agg(F.count("*").alias("n"))
    some = Window.partitionBy(*keys, "attribute").orderBy("v")
    # the first few values of a key are marked before they are listed: no list grows with the data
    each = each.withColumn("_k", F.row_number().over(some))
    out = each.groupBy(*keys, "attribute").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.array_sort(F.collect_list(F.when(F.col("_k") <= examples, F.col("v")))).alias("examples"))
    return out.where("n_distinct > 1").withColumn("examples", F.array_join("examples", "|"))


def duplicate_report(df: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, rows that repeat an earlier one in all columns, rows that share their key with another, keys that do."""
    whole = df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_exact_duplicates"))
    keys = df.groupBy(*(key or df.columns)).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_key_duplicates"), F.count("*").alias("n_keys"))
    return whole.crossJoin(keys)


def rate_funnel(df: DataFrame, target: str, by: str, level: float = 0.95, small: int = 30) -> DataFrame:
    """(by, n, positives, rate, overall_rate, funnel_low, funnel_high, outside_funnel, small_group): each group's rate against binomial bounds around the overall rate. That a group is small is told apart, and doesn't keep it inside."""
    z = normal_quantile(0.5 + level / 2)
    y = F.col(target).cast("double")
    g = df.where(F.col(by).isNotNull() & y.isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(y).alias("rate"), F.sum(y).alias("_s"))
    whole = Window.partitionBy(F.lit(1))
    p = F.sum("_s").over(whole) / F.sum("n").over(whole)
    g = g.withColumn("_p", p).withColumn("_h", z * F.sqrt(F.col("_p") * (1 - F.col("_p")) / F.col("n")))
    low, high = F.col("_p") - F.col("_h"), F.col("_p") + F.col("_h")
    return g.select(by, "n", F.col("_s").cast("long").alias("positives"), F.round("rate", 4).alias("rate"), F.round("_p", 4).alias("overall_rate"), F.round(F.greatest(F.lit(0.0), low), 4).alias("funnel_low"), F.round(F.least(F.lit(1.0), high), 4).alias("funnel_high"), ((F.col("rate") < low) | (F.col("rate") > high)).alias("outside_funnel"), (F.col("n") < small).alias("small_group"))


_FAMILIES = {"equidispersed": "poisson", "overdispersed": "negative_binomial", "underdispersed": "binomial_like"}


def count_dispersion(df: DataFrame, column: str, tolerance: float = 0.25) -> DataFrame:
    """One row: n, mean, variance, vmr (variance over mean), dispersion_stat with both tails' p, observed and Poisson shares of zeros, excess_zeros, verdict and family.

    verdict, in this order: insufficient_data (fewer than 10), not_count_data (negative, infinite or fractional values, or nothing but zeros), over-, under-, equidispersed by vmr alone. Of the first two only n is told."""
    x = F.col(column).cast("double")
    whole = F.abs(x - F.bround(x, 0)) <= 1e-8 + 1e-5 * F.abs(F.bround(x, 0))
    a = df.where(x.isNotNull() & ~F.isnan(x)).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v"), F.avg((x == 0).cast("int")).alias("z"), F.count_if((x < 0) | (F.abs(x) == float("inf")) | ~whole).alias("bad")).first()
    schema = "n long, mean double, variance double, vmr double, dispersion_stat double, p_overdispersion double, p_underdispersion double, zero_rate_observed double, zero_rate_poisson double, excess_zeros boolean, verdict string, family string"
    if a.n < 10 or a.bad or a.m == 0:
        row = (a.n, *[None] * 9, "insufficient_data" if a.n < 10 else "not_count_data", None)
    else:
        vmr, stat = a.v / a.m, (a.n - 1) * a.v / a.m
        tail, expect = chi2_tail(stat, a.n - 1), math.exp(-a.m)
        verdict = "overdispersed" if vmr > 1 + tolerance else "underdispersed" if vmr < 1 - tolerance else "equidispersed"
        row = (a.n, round(a.m, 6), round(a.v, 6), round(vmr, 4), round(stat, 4), round(tail, 6), round(1 - tail, 6), round(a.z, 4), round(expect, 4), a.z > expect + 0.05, verdict, _FAMILIES[verdict])
    return df.sparkSession.createDataFrame([row], schema)


def mean_variance_scaling(df: DataFrame, column: str, by: str, least: int = 5) -> DataFrame:
    """One row: slope and R2 of log variance on log mean over groups."""
    g = df.groupBy(by).agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.var_samp(column).alias("v")).where((F.col("n") >= least) & (F.col("m") > 0) & (F.col("v") > 0))
    return g.agg(F.count("*").alias("n_groups"), F.regr_slope(F.log("v"), F.log("m")).alias("slope"), F.regr_r2(F.log("v"), F.log("m")).alias("r2"))


def rate_homogeneity(groups: DataFrame, count: str, exposure: str | None = None, level: float = 0.05) -> DataFrame:
    """One row (chi2, df, p, safe_to_aggregate): chi-square test of one rate over the groups."""
    e = F.col(exposure) if exposure else F.lit(1.0)
    t = groups.agg(F.sum(count).alias("c"), F.sum(e).alias("e"), F.count("*").alias("k")).first()
    if not t.c or not t.e or t.k < 2:
        return groups.sparkSession.createDataFrame([(None, None, None, None)], "chi2 double, df long, p double, safe_to_aggregate boolean")
    expect = e * (t.c / t.e)
    x = groups.agg(F.sum((F.col(count) - expect) * (F.col(count) - expect) / expect).alias("x")).first().x
    p = chi2_tail(x, t.k - 1)
    return groups.sparkSession.createDataFrame([(float(x), t.k - 1, p, p >= level)], "chi2 double, df long, p double, safe_to_aggregate boolean")


def decile_ratio(df: DataFrame, column: str, p: float = 0.1) -> DataFrame:
    """One row: mean of the greatest share p over mean of the least; null unless the latter is positive. The cuts are exact counts."""
    r = ordered_sums(levels(df, finite(column))).withColumn("k", F.greatest(F.lit(1), F.bround(F.col("n_all") * p).cast("long")))
    low = F.greatest(F.lit(0), F.least(F.col("n"), F.col("k") - F.col("n_before")))
    high = F.greatest(F.lit(0), F.least(F.col("n"), F.col("n_before") + F.col("n") - (F.col("n_all") - F.col("k"))))
    means = r.agg(F.try_divide(F.sum(F.col("x") * low), F.max("k")).alias("low_mean"), F.try_divide(F.sum(F.col("x") * high), F.max("k")).alias("high_mean"))
    return means.withColumn("ratio", F.when(F.col("low_mean") > 0, F.col("high_mean") / F.col("low_mean")))


#: Levels beyond which a column is no category.
MOST_CATEGORIES = 100_000


def population_shift(reference: DataFrame, current: DataFrame, column: str, buckets: int = 10, categorical: bool | None = None, eps: float | None = None) -> DataFrame:
    """One row (n_ref, n_cur, kind, n_bins, rows_per_bucket, psi, psi_null_expected, psi_ratio, psi_reliable, ks_stat, ks_p, wasserstein, wasserstein_scaled, chi2_p, unseen, verdict): how far a column has moved.

    Numbers of more than max(buckets, 20) kinds in the reference are binned by its quantiles, [a, b); other columns go by category. Shares are at least half a row (or eps). The population stability index is judged against
    0.1 and 0.25 and against 2 and 3 times what two samples of one population give, so small samples don't alarm. unseen lists up to 100 categories that only current has, with their number.
    verdict: insufficient_data (fewer than 2 values on a side), degenerate_reference (fewer than 3 edges), stable, moderate_shift, major_shift. ks_p is the asymptotic one. Measures of the other kind are null."""
    spark = reference.sparkSession
    kinds = [d.schema[column].dataType for d in (reference, current)]
    there = [d.where(~missing(d, column)) for d in (reference, current)]
    number = all(isinstance(k, T.NumericType) for k in kinds)
    seen = there[0].agg(F.count("*").alias("n"), F.count_distinct(column).alias("k"), F.stddev_pop(F.col(column).cast("double")).alias("sd") if number else F.lit(None).cast("double").alias("sd")).first()
    a, b = seen.n, there[1].count()
    out = {"n_ref": a, "n_cur": b}
    schema = "n_ref long, n_cur long, kind string, n_bins int, rows_per_bucket double, psi double, psi_null_expected double, psi_ratio double, psi_reliable boolean, ks_stat double, ks_p double, wasserstein double, wasserstein_scaled double, chi2_p double, n_unseen long, unseen array<string>, verdict string"
    answer = lambda: spark.createDataFrame([tuple(out.get(c.split()[0]) for c in schema.split(", "))], schema)
    if min(a, b) < 2:
        out["verdict"] = "insufficient_data"
        return answer()
    numeric = number and seen.k > max(buckets, 20) if categorical is None else not categorical
    out["kind"] = "numeric" if numeric else "categorical"
    if numeric:
        x = F.col(column).cast("double")
        edges = sorted({v for v in quantiles(there[0], x, [k / buckets for k in range(buckets + 1)], [f"e{k}" for k in range(buckets + 1)]).first()})
        if len(edges) < 3:
            out["verdict"] = "degenerate_reference"
            return answer()
        both = there[0].select(x.alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(there[1].select(x.alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
        level = levels(both, F.col("v"), a=F.col("a"), b=F.col("b"))
        bin_ = sum((F.col("x") >= e).cast("int") for e in edges[1:-1])
        shares = {r.k: (r.a, r.b) for r in level.groupBy(bin_.alias("k")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}  # a row a bin
        cells = [shares.get(k, (0, 0)) for k in range(len(edges) - 1)]
        steps = ordered_sums(level, sums=("a", "b"), following=True)
        gap = F.abs((F.col("a_before") + F.col("a")) / a - (F.col("b_before") + F.col("b")) / b)
        ks, w = steps.agg(F.max(gap), F.sum(gap * (F.col("next_x") - F.col("x")))).first()
        out |= {"ks_stat": round(ks, 6), "ks_p": kolmogorov_tail(ks * math.sqrt(a * b / (a + b))), "wasserstein": round(w or 0.0, 6), "wasserstein_scaled": round((w or 0.0) / seen.sd, 6) if seen.sd else None}
    else:
        c = F.col(column).cast("string")
        counted = there[0].select(c.alias("c"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(there[1].select(c.alias("c"), F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy("c").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        rows = counted.limit(MOST_CATEGORIES + 1).collect()
        if len(rows) > MOST_CATEGORIES:
            raise ValueError(f"{column} has more than {MOST_CATEGORIES} categories")
        cells = [(r.a, r.b) for r in rows]
        unseen = sorted(r.c for r in rows if not r.a)
        x2 = sum((p - (p + q) * a / (a + b)) ** 2 / ((p + q) * a / (a + b)) + (q - (p + q) * b / (a + b)) ** 2 / ((p + q) * b / (a + b)) for p, q in cells)
        if len(cells) == 2:  # Yates
            x2 = sum((max(0.0, abs(v - (p + q) * n / (a + b)) - 0.5)) ** 2 / ((p + q) * n / (a + b)) for p, q in cells for v, n in ((p, a), (q, b)))
        out |= {"chi2_p": chi2_tail(x2, len(cells) - 1) if len(cells) > 1 else 1.0, "n_unseen": len(unseen), "unseen": unseen[:100]}
    floors = (0.5 / a if eps is None else eps, 0.5 / b if eps is None else eps)
    pairs = [(max(p / a, floors[0]), max(q / b, floors[1])) for p, q in cells]
    psi, null = sum((p - q) * math.log(p / q) for p, q in pairs), (len(cells) - 1) * (1 / a + 1 / b)
    room = min(a, b) / len(cells)
    out |= {"n_bins": len(cells), "rows_per_bucket": round(room, 1), "psi": round(psi, 6), "psi_null_expected": round(null, 6), "psi_ratio": round(psi / null, 3) if null else None, "psi_reliable": room >= 50}
    out["verdict"] = "major_shift" if psi >= 0.25 and psi > 3 * null else "moderate_shift" if psi >= 0.1 and psi > 2 * null else "stable"
    return answer()


def datetime_checks(df: DataFrame, column: str, least_year: int = 1900, most_year: int = 2100) -> DataFrame:
    """One row: how many strings read as times, as ambiguous days and months, as seconds or milliseconds since 1970, and years out of range."""
    s = F.col(column).cast("string")
    t = F.expr(f"try_cast(CAST(`{column}` AS string) AS timestamp)")
    n = F.expr(f"try_cast(CAST(`{column}` AS string) AS double)")
    dm = s.rlike(r"^(0?[1-9]|1[0-2])[/.-](0?[1-9]|1[0-2])[/.-]\d{4}")
    return df.where(s.isNotNull()).agg(F.count("*").alias("n"), F.count_if(t.isNotNull() & s.rlike(r"^\d{4}-")).alias("n_times"), F.count_if(dm).alias("n_ambiguous"), F.count_if((n >= 1e8) & (n <= 4e9)).alias("n_epoch_seconds"), F.count_if((n >= 1e11) & (n <= 4e12)).alias("n_epoch_millis"), F.count_if(s.rlike(r"^\d{4}-") & ((F.year(t) < least_year) | (F.year(t) > most_year))).alias("n_implausible_year"))


def keys_across_splits(df: DataFrame, split: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def structural_checks(train: DataFrame, test: DataFrame, keys: Sequence[str], categories: Sequence[str], expected: Sequence[str]) -> DataFrame:
    """(check, n, ok): expected columns that are absent, columns that differ, keys on both sides, categories that only test has."""
    rows = [("missing_columns", len(set(expected) - set(train.columns))), ("differing_columns", len(set(train.columns) ^ set(test.columns)))]
    out = train.sparkSession.createDataFrame(rows, "check string, n long")
    shared = train.select(*keys).distinct().join(test.select(*keys).distinct(), list(keys))
    out = out.unionByName(shared.agg(F.lit("key_overlap").alias("check"), F.count("*").alias("n")))
    for c in categories:
        unseen = test.select(c).where(F.col(c).isNotNull()).distinct().join(train.select(c).distinct(), c, "left_anti")
        out = out.unionByName(unseen.agg(F.lit(f"unseen:{c}").alias("check"), F.count("*").alias("n")))
    return out.withColumn("ok", F.col("n") == 0)


def readiness(checks: DataFrame, accepted: Sequence[str] = ()) -> DataFrame:
    """One row: ready, ready_with_accepted_limitations or not_ready."""
    open_ = F.count_if(~F.col("ok") & ~F.col("check").isin(list(accepted)))
    limits = F.count_if(~F.col("ok"))
    return checks.agg(open_.alias("n_open"), limits.alias("n_failed")).withColumn("verdict", F.when(F.col("n_open") > 0, "not_ready").when(F.col("n_failed") > 0, "ready_with_accepted_limitations").otherwise("ready"))


def proxy_label(params: DataFrame) -> DataFrame:
    """params (sensitivity, specificity, prevalence) with the values of a proxy label's verdicts."""
    tp, fp = F.col("sensitivity") * F.col("prevalence"), (1 - F.col("specificity")) * (1 - F.col("prevalence"))
    fn, tn = (1 - F.col("sensitivity")) * F.col("prevalence"), F.col("specificity") * (1 - F.col("prevalence"))
    ppv = F.try_divide(tp, tp + fp)
    return params.withColumns({"ppv": ppv, "npv": F.try_divide(tn, tn + fn), "apparent_rate": tp + fp, "inflation": F.try_divide(tp + fp, F.col("prevalence")), "verdict": F.when(ppv < 0.5, "mostly_false").when(ppv < 0.9, "noisy").otherwise("usable")})
