"""Joins, aggregations and set operations beyond a single DataFrame call."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usage_stats(events: DataFrame, entity: str, kind: str) -> DataFrame:
    """Counts by (kind, entity) and totals by kind, in one pass; the totals' rows have a null entity and is_total."""
    return events.groupingSets([[F.col(kind), F.col(entity)], [F.col(kind)]], F.col(kind), F.col(entity)).agg(F.count("*").alias("n"), (F.grouping(entity) == 1).alias("is_total"))


def accepted(events: DataFrame, rule: Column) -> DataFrame:
    """events with ok: whether the rule holds; null counts as no."""
    return events.withColumn("ok", F.coalesce(rule, F.lit(False)))


def stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """mean, sample deviation, least, greatest and number; all 0 where there are no values, deviation 0 for one value."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(zero(F.avg(v)).alias("mean"), zero(F.stddev_samp(v)).alias("std"), zero(F.min(v)).alias("least"), zero(F.max(v)).alias("greatest"), F.count(v).alias("n"))


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in an order that has to tell rows apart."""
    row = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    row = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def as_of(facts: DataFrame, versions: DataFrame, key: str, at: str, since: str, values: Sequence[str]) -> DataFrame:
    """facts with the values of the last version of their key that isn't later; null where there is none, or where key or time is null.

    Both sides lie in one window by key and time, versions first: one shuffle, linear, no pairs. Of versions of one time the one of greatest values counts."""
    left = facts.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*facts.columns).alias("_fact"), F.lit(None).cast(versions.select(F.struct(*values)).schema[0].dataType).alias("_version"))
    right = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("_key"), F.col(since).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_fact"].dataType).alias("_fact"), F.struct(*values).alias("_version"))
    w = Window.partitionBy("_key").orderBy(F.col("_at").asc_nulls_first(), "_side", "_version").rowsBetween(Window.unboundedPreceding, 0)
    out = left.unionByName(right).withColumn("_found", F.last("_version", ignorenulls=True).over(w)).where("_side = 1")
    known = F.col("_key").isNotNull() & F.col("_at").isNotNull()
    return out.select("_fact.*", *[F.when(known, F.col(f"_found.{v}")).alias(v) for v in values])


def valid_at(facts: DataFrame, versions: DataFrame, key: str, at: str, begin: str, end: str, values: Sequence[str]) -> DataFrame:
    """Temporal left join with versions valid from begin to before end (null: open)."""
    v = versions.select(F.col(key).alias("_key"), F.col(begin).alias("_begin"), F.col(end).alias("_end"), *values)
    on = (F.col(key) == F.col("_key")) & (F.col(at) >= F.col("_begin")) & (F.col("_end").isNull() | (F.col(at) < F.col("_end")))
    return facts.join(v, on, "left").select(*facts.columns, *values)


def intervals(df: DataFrame, key: str, at: str, values: Sequence[str]) -> DataFrame:
    """Versions of slowly changing values: a row for each change, valid from valid_from to before valid_to (null: still)."""
    w = Window.partitionBy(key).orderBy(at)
    state = F.struct(*values)
    changed = df.withColumn("_before", F.lag(state).over(w)).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(state))
    return changed.select(key, *values, F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"))


def overlaps(spans: DataFrame, key: Sequence[str], span_id: str, begin: str, end: str, width: int) -> DataFrame:
    """(a, b) of spans of one key that overlap, a < b; begin and end are whole numbers, end exclusive.

    Spans meet in buckets of `width`, each pair counted in the bucket where the later of the two begins: an equi-join, however the spans lie."""
    live = spans.where(F.col(begin) < F.col(end))
    bucket = F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor((F.col(end) - 1) / width)))
    s = live.select(*key, F.col(span_id).alias("a"), F.col(begin).alias("_ab"), F.col(end).alias("_ae"), bucket.alias("_bucket"))
    t = s.select(*key, F.col("a").alias("b"), F.col("_ab").alias("_bb"), F.col("_ae").alias("_be"), "_bucket")
    met = s.join(t, [*key, "_bucket"]).where((F.col("a") < F.col("b")) & (F.col("_ab") < F.col("_be")) & (F.col("_bb") < F.col("_ae")))
    return met.where(F.col("_bucket") == F.floor(F.greatest("_ab", "_bb") / width)).select(*key, "a", "b")


def max_concurrency(spans: DataFrame, key: Sequence[str], begin: str, end: str) -> DataFrame:
    """The most spans that are open at once; one that ends as another begins has ended before."""
    marks = spans.select(*key, F.explode(F.array(F.struct(F.col(begin).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("m")).select(*key, "m.t", "m.d")
    steps = marks.groupBy(*key, "t", "d").agg(F.sum("d").alias("s"))
    w = Window.partitionBy(*key).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("open", F.sum("s").over(w)).groupBy(*key).agg(F.max("open").alias("max_open"))


def missing_targets(refs: DataFrame, targets: DataFrame, ref: str, target: str) -> DataFrame:
    """References to nothing; a null refers to nothing and isn't missing."""
    return refs.where(F.col(ref).isNotNull()).join(targets.select(F.col(target).alias("_target")).distinct(), F.col(ref) == F.col("_target"), "left_anti")


def fused_ranks(a: DataFrame, b: DataFrame, key: str, rank: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    both = a.select(key, F.col(rank).alias("_a")).join(b.select(key, F.col(rank).alias("_b")), key, "full_outer")
    return both.select(key, (part("_a") + part("_b")).alias("score"))


def aligned(a: DataFrame, b: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Values of two series side by side, with their difference where both have one."""
    x, y = (d.select(*key, F.col(value).alias(n)) for d, n in ((a, "before"), (b, "after")))
    return x.join(y, list(key), "full_outer").withColumn("delta", F.col("after") - F.col("before"))


def flags(candidate: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """(key, flags) of two tables of (key, n, rate, cost): missing_data (either has no rows), non_discriminating (both always pass), always_failing (both never do), flaky (either strictly between 20 and 80 %), cost_regression (above 1.25 times, where both have a cost)."""
    x, y = (d.select(key, *[F.col(c).alias(f"{p}_{c}") for c in ("n", "rate", "cost")]) for d, p in ((candidate, "c"), (base, "b")))
    there = {p: F.coalesce(f"{p}_n", F.lit(0)) > 0 for p in "cb"}
    both = there["c"] & there["b"]
    mixed = lambda p: there[p] & (F.col(f"{p}_rate") > 0.2) & (F.col(f"{p}_rate") < 0.8)
    rules = [
        (~both, "missing_data"),
        (both & (F.col("c_rate") == 1) & (F.col("b_rate") == 1), "non_discriminating"),
        (both & (F.col("c_rate") == 0) & (F.col("b_rate") == 0), "always_failing"),
        (F.coalesce(mixed("c"), F.lit(False)) | F.coalesce(mixed("b"), F.lit(False)), "flaky"),
        ((F.col("c_cost") > 0) & (F.col("b_cost") > 0) & (F.col("c_cost") > 1.25 * F.col("b_cost")), "cost_regression"),
    ]
    return x.join(y, key, "full_outer").select(key, F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules])), ",").alias("flags"))


def retention(events: DataFrame, entity: str, at: str) -> DataFrame:
    """(cohort, week, entities): how many entities of each first week are seen so many weeks later."""
    weeks = events.select(F.col(entity).alias("e"), F.date_trunc("week", F.col(at).cast("timestamp")).cast("date").alias("w")).distinct()
    first = weeks.withColumn("cohort", F.min("w").over(Window.partitionBy("e")))
    return first.groupBy("cohort", (F.datediff("w", "cohort") / 7).cast("int").alias("week")).agg(F.count("*").alias("entities"))


def recent_totals(df: DataFrame, order: str, values: Sequence[str], rows: int) -> DataFrame:
    """One row: sums over the newest `rows` rows and over all. The newest are found by a bounded sort (one heap a task), not by a window over everything."""
    newest = df.orderBy(F.col(order).desc_nulls_last()).limit(rows).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"recent_{v}") for v in values])
    return df.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"all_{v}") for v in values]).crossJoin(newest)


def pivoted(df: DataFrame, by: str, across: str, levels: Sequence[str], value: Column) -> DataFrame:
    """One column a level; levels are named, so no job looks for them."""
    return df.groupBy(by).pivot(across, list(levels)).agg(value)


def islands(df: DataFrame, key: Sequence[str], n: str) -> DataFrame:
    """Runs of consecutive whole numbers by key."""
    d = df.select(*key, n).distinct().withColumn("_g", F.col(n) - F.row_number().over(Window.partitionBy(*key).orderBy(n)))
    return d.groupBy(*key, "_g").agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count("*").alias("length")).drop("_g")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k a task before the shuffle (WindowGroupLimit)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def hierarchy_paths(edges: DataFrame, parent: str, child: str, depth: int) -> DataFrame:
    """(root, node, depth, is_cycle) of all downward walks of at most `depth` edges from each parent; a walk that comes back on itself ends there, marked."""
    e = edges.select(F.col(parent).alias("_p"), F.col(child).alias("_c")).where("_p IS NOT NULL AND _c IS NOT NULL").distinct()
    at = e.select(F.col("_p").alias("root"), F.col("_c").alias("node"), F.array("_p", "_c").alias("path"), F.lit(1).alias("depth"), (F.col("_p") == F.col("_c")).alias("is_cycle"))
    out = at
    for k in range(2, depth + 1):
        at = at.where("NOT is_cycle").join(e, F.col("node") == F.col("_p")).select("root", F.col("_c").alias("node"), F.concat("path", F.array("_c")).alias("path"), F.lit(k).alias("depth"), F.array_contains("path", F.col("_c")).alias("is_cycle"))
        out = out.unionByName(at)
    return out.select("root", "node", "depth", "is_cycle")


def rules_report(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """(rule, violations, rate, unevaluable) of named SQL conditions over all rows, in one pass; a rule that can't be analysed is reported with its error instead of raised."""
    good, bad = [], []
    for name, text in rules.items():
        try:
            df.select(F.expr(text).cast("boolean"))
            good.append((name, F.expr(text).cast("boolean")))
        except Exception as error:  # the analyser's message is the result
            bad.append((name, str(error).split("\n")[0][:200]))
    spark = df.sparkSession
    out = None
    if good:
        entries = F.array(*[F.struct(F.lit(n).alias("rule"), F.count_if(~c).alias("violations"), F.count_if(c.isNull()).alias("unevaluable"), F.count("*").alias("n"), F.lit(None).cast("string").alias("error")) for n, c in good])
        out = df.agg(entries.alias("e")).select(F.explode("e").alias("e")).select("e.rule", "e.violations", F.try_divide("e.violations", F.col("e.n") - F.col("e.unevaluable")).alias("rate"), "e.unevaluable", "e.error")
    if bad:
        broken = spark.createDataFrame(bad, "rule string, error string").selectExpr("rule", "CAST(NULL AS bigint) AS violations", "CAST(NULL AS double) AS rate", "CAST(NULL AS bigint) AS unevaluable", "error")
        out = broken if out is None else out.unionByName(broken)
    return out if out is not None else spark.createDataFrame([], "rule string, violations bigint, rate double, unevaluable bigint, error string")
