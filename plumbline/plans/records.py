"""Records and usage logs, read from orders, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..registry import query
from ..sources.tables import table


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN false WHEN o_orderstatus = 'F' THEN o_totalprice >= 100000 ELSE o_orderstatus = 'O' END AS passed FROM orders")
def record_outcomes(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.outcome(F.when(F.col("o_orderpriority") == "5-LOW", 0.5).otherwise(1.0), F.when(s == "F", F.col("o_totalprice")), F.lit(100000.0), F.when(s != "O", F.lit("error"))).alias("passed"))


@query("SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS label, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS pass_rate, avg(o_totalprice) AS o_totalprice_mean, coalesce(stddev_samp(o_totalprice), 0) AS o_totalprice_std FROM orders GROUP BY 1")
def node_stats(spark, sf_dir):
    return R.node_stats(table(spark, sf_dir, "orders").withColumn("p", F.col("o_orderstatus") == "F"), "o_custkey", "p", "o_orderpriority", "o_orderkey", ["o_totalprice"])


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS run, user_id, arg_max(CASE WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END, event_id) AS r FROM events GROUP BY 1, 2), n AS (SELECT DISTINCT run FROM d ORDER BY run DESC LIMIT 2), a AS (SELECT * FROM d WHERE run = (SELECT min(run) FROM n)), b AS (SELECT * FROM d WHERE run = (SELECT max(run) FROM n))
SELECT coalesce(a.user_id, b.user_id) AS user_id, a.r AS before, b.r AS after, CASE WHEN a.r IS NULL THEN 'new' WHEN b.r IS NULL THEN 'gone' WHEN a.r = b.r THEN 'same' WHEN b.r = 'pass' THEN 'fixed' ELSE 'broken' END AS flip FROM a FULL JOIN b ON a.user_id = b.user_id
""")
def run_flips(spark, sf_dir):
    h = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("run"), "user_id", "event_id", F.when(F.col("event_type") == "error", "fail").otherwise("pass").alias("r"))
    return R.flips(h, "run", "user_id", "r", "event_id")


@query("""
WITH o AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) = 1), p AS (SELECT *, CASE WHEN event_type LIKE 'c%' THEN 3.0 WHEN event_type LIKE '%s%' THEN 2.0 ELSE 1.0 END AS p FROM o)
SELECT event_type, count(*) AS calls, CAST(sum(user_id % 7) AS BIGINT) AS fresh, CAST(sum(user_id % 3) AS BIGINT) AS cached, sum(user_id % 3) / sum(user_id % 7 + user_id % 3) AS cache_hit, round(sum(p * (user_id % 7)), 6) AS cost FROM p GROUP BY 1
""")
def usage_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"day": F.col("ts").cast("date"), "fresh": F.col("user_id") % 7, "cached": F.col("user_id") % 3})
    return R.usage_totals(e, ["user_id", "day"], "event_id", ["event_type"], "fresh", "cached", R.price(F.col("event_type"), {"^c": 3.0, "s": 2.0}, 1.0) * F.col("fresh")).withColumn("cost", F.round("cost", 6))


@query("SELECT conv_id, left(trim(regexp_replace(arg_min(text, turn) FILTER (role = 'user'), '\\s+', ' ', 'g')), 70) AS title FROM conversations GROUP BY 1")
def session_titles(spark, sf_dir):
    return R.titles(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(greatest(1, user_id % 4)) AS BIGINT) AS checkouts FROM events GROUP BY 1")
def attempts_by_day(spark, sf_dir):
    return R.attempts_by_day(table(spark, sf_dir, "events").withColumn("a", F.col("user_id") % 4), "ts", "a")


@query("SELECT user_id, epoch(max(ts)) - epoch(min(ts)) AS seconds FROM events GROUP BY 1")
def session_spans(spark, sf_dir):
    return R.spans_by_key(table(spark, sf_dir, "events"), "user_id", "ts")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r % 10 = 0")
def every_tenth(spark, sf_dir):
    return R.every_nth(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 10).select("o_orderkey")
