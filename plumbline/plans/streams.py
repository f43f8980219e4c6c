"""Structured Streaming over the events table, each run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.relational import last_per_key
from ..registry import query
from ..sources.tables import table
from ..streaming import events as E


def _stream(spark, sf_dir):
    """The events of the folder as a stream of files."""
    return E.read_files(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)


def _name(what: str) -> str:
    return f"stream-{what}-{uuid.uuid4().hex}"


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begin, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    out = E.tumbling(_stream(spark, sf_dir), "ts", "1 hour", ["event_type"])
    return E.collect_available(out, _name("tumbling"), "complete").select(F.col("begin").cast("timestamp_ntz").alias("begin"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT b AS begin, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS b FROM events) GROUP BY 1, 2")
def sliding_windows(spark, sf_dir):
    out = E.sliding(_stream(spark, sf_dir), "ts", "1 hour", "30 minutes", ["event_type"])
    return E.collect_available(out, _name("sliding"), "complete").select(F.col("begin").cast("timestamp_ntz").alias("begin"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM i GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    out = E.sessions(_stream(spark, sf_dir), "ts", "2 hours", ["user_id"])
    return E.collect_available(out, _name("session"), "complete").select("user_id", F.col("begin").cast("timestamp_ntz").alias("begin"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_id, value FROM events")
def deduplicated_stream(spark, sf_dir):
    s = _stream(spark, sf_dir).select("event_id", "ts", "value").withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    return E.collect_available(E.deduplicated(s, "ts", ["event_id"]), _name("dedup"), "append").select("event_id", "value")


@query("SELECT event_id, CASE WHEN value > 90 THEN 'high' ELSE '' END AS failed FROM events WHERE event_type <> 'error'")
def stream_expectations(spark, sf_dir):
    s = E.expectations(_stream(spark, sf_dir), {"high": (F.col("value") <= 90, "warn"), "kind": (F.col("event_type") != "error", "drop"), "id": (F.col("event_id").isNotNull(), "fail")})
    return E.collect_available(s, _name("expect"), "append").select("event_id", F.array_join("failed", ",").alias("failed"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'logout'")
def apply_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    state = last_per_key(e.where("event_id % 2 = 0").withColumn("is_deleted", F.col("event_type") == "logout"), ["user_id"], ["event_id"]).drop("event_type")
    # every change arrives, in any order, the ones that are applied already too
    done = E.apply_changes(state, e, ["user_id"], "event_id", F.col("event_type") == "logout")
    return done.where("NOT is_deleted").drop("is_deleted")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def running_totals(spark, sf_dir):
    """State by user, carried over batches; the last update of each user counts."""
    out = E.collect_available(E.running_totals(_stream(spark, sf_dir), "user_id", "value"), _name("state"), "update")
    return last_per_key(out, ["key"], ["batch"]).select(F.col("key").alias("user_id"), "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS greatest FROM events GROUP BY 1")
def incremental_totals(spark, sf_dir):
    """A materialised aggregate of the first half, brought up to date by that of the second."""
    from ..sources.tables import merged_totals

    e = table(spark, sf_dir, "events")
    part = lambda d: d.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("greatest"))
    return merged_totals(part(e.where("event_id % 2 = 0")), part(e.where("event_id % 2 = 1")), ["event_type"], ["n", "total"], greatest=["greatest"]).withColumn("total", F.round("total", 4))


@query("SELECT day, CAST(day - INTERVAL 12 DAY AS DATE) AS since FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)")
def lookback_starts(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day")).distinct()
    return d.select("day", E.lookback_start(F.col("day"), 2, 3, 7).alias("since"))
