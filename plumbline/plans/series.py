"""Ordered data over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from ..registry import query
from ..sources.tables import table

_DAILY = "SELECT event_type, CAST(ts AS DATE) AS day, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS i, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL"


def daily(spark, sf_dir):
    d = F.col("ts").cast("date")
    return table(spark, sf_dir, "events").groupBy("event_type", d.alias("day")).agg(F.count("*").cast("double").alias("n")).withColumn("i", F.datediff("day", F.lit("2024-01-01")))


@query(f"WITH d AS ({_DAILY}) SELECT event_type, day, lag(n, 1) OVER w AS n_lag1, lag(n, 7) OVER w AS n_lag7 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)")
def lags(spark, sf_dir):
    return S.add_lags(daily(spark, sf_dir), "n", [1, 7], ["day"], ["event_type"]).select("event_type", "day", "n_lag1", "n_lag7")


@query(f"WITH d AS ({_DAILY}) SELECT event_type, day, n - lag(n, 1) OVER w AS n_diff1, n - lag(n, 7) OVER w AS n_diff7 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)")
def differences(spark, sf_dir):
    return S.add_difference(daily(spark, sf_dir), "n", ["day"], [1, 7], ["event_type"]).select("event_type", "day", "n_diff1", "n_diff7")


@query(f"WITH d AS ({_DAILY}) SELECT event_type, day, CASE WHEN count(n) OVER w = 3 THEN avg(n) OVER w END AS n_roll3_mean, CASE WHEN count(n) OVER w = 3 THEN stddev_samp(n) OVER w END AS n_roll3_std FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
def rolling(spark, sf_dir):
    return S.add_rolling(daily(spark, sf_dir), "n", [3], ["day"], group=["event_type"]).select("event_type", "day", "n_roll3_mean", "n_roll3_std")


@query(f"WITH d AS ({_DAILY}) SELECT event_type, day, avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_expanding_mean FROM d")
def expanding(spark, sf_dir):
    return S.add_expanding(daily(spark, sf_dir), "n", ["day"], group=["event_type"]).select("event_type", "day", "n_expanding_mean")


@query(f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS r FROM ({_DAILY}))
SELECT a.event_type, a.day, sum(b.n * pow(0.5, a.r - b.r)) / sum(pow(0.5, a.r - b.r)) AS n_ewm3 FROM d a LEFT JOIN d b ON a.event_type = b.event_type AND b.r < a.r GROUP BY 1, 2
""")
def exponential_mean(spark, sf_dir):
    return S.add_ewm(daily(spark, sf_dir), "n", [3], ["day"], ["event_type"]).select("event_type", "day", "n_ewm3")


@query("SELECT event_id, year(ts) AS ts_year, month(ts) AS ts_month, isodow(ts) - 1 AS ts_dow, hour(ts) AS ts_hour, sin(2 * pi() * month(ts) / 12) AS ts_month_sin, cos(2 * pi() * month(ts) / 12) AS ts_month_cos, sin(2 * pi() * (isodow(ts) - 1) / 7) AS ts_dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS ts_dow_cos FROM events")
def calendar(spark, sf_dir):
    return S.add_calendar(table(spark, sf_dir, "events").select("event_id", "ts"), "ts").drop("ts")


@query(f"SELECT event_type, i, sin(2 * pi() * i / 7) AS fourier_sin1, cos(2 * pi() * i / 7) AS fourier_cos1, sin(4 * pi() * i / 7) AS fourier_sin2, cos(4 * pi() * i / 7) AS fourier_cos2 FROM ({_DAILY})")
def fourier_terms(spark, sf_dir):
    return S.add_fourier(daily(spark, sf_dir).select("event_type", "i"), "i", 7, 2)


@query("WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, day, CAST(sum(n) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS week FROM d")
def sliding_week(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return S.sliding_days(d, ["o_custkey"], "day", "n", 7, "week").drop("n")


@query(f"""
WITH d AS (SELECT event_type, n - avg(n) OVER (PARTITION BY event_type) AS d, row_number() OVER (PARTITION BY event_type ORDER BY day) AS r FROM ({_DAILY}))
SELECT a.event_type, k AS lag, coalesce(sum(a.d * b.d), 0) / nullif(any_value(v), 0) AS r FROM d a CROSS JOIN range(0, 6) t(k) LEFT JOIN d b ON a.event_type = b.event_type AND b.r = a.r - k JOIN (SELECT event_type, sum(d * d) AS v FROM d GROUP BY 1) s ON s.event_type = a.event_type GROUP BY 1, 2
""")
def autocorrelation(spark, sf_dir):
    return S.acf(daily(spark, sf_dir), "n", ["day"], 5, ["event_type"])


_W = S.frac_diff_weights(0.4, 0.05)


@query(f"WITH d AS ({_DAILY}) SELECT event_type, day, " + " + ".join(f"({w!r}) * " + (f"lag(n, {k}) OVER w" if k else "n") for k, w in enumerate(_W)) + " AS n_fd FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)")
def fractional_difference(spark, sf_dir):
    return S.frac_diff(daily(spark, sf_dir), "n", 0.4, ["day"], ["event_type"], 0.05).select("event_type", "day", "n_fd")


@query("""
WITH e AS (SELECT event_type, date_trunc('hour', ts) AS t, min(value) AS v FROM events GROUP BY ALL), s AS (SELECT event_type, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM e GROUP BY 1)
SELECT s.event_type, s.t, last_value(e.v IGNORE NULLS) OVER (PARTITION BY s.event_type ORDER BY s.t) AS v FROM s LEFT JOIN e ON s.event_type = e.event_type AND s.t = e.t
""")
def regular_grid(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("t")).agg(F.min("value").alias("v"))
    return S.to_regular_grid(e, "t", "1 HOUR", ["v"], ["event_type"]).select("event_type", F.col("t").cast("timestamp_ntz").alias("t"), "v")


@query("""
WITH e AS (SELECT event_type, date_trunc('hour', ts) AS t, min(value) AS v FROM events GROUP BY ALL), s AS (SELECT event_type, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM e GROUP BY 1)
SELECT s.event_type, s.t, last_value(e.v IGNORE NULLS) OVER (PARTITION BY s.event_type ORDER BY s.t) AS v FROM s LEFT JOIN e ON s.event_type = e.event_type AND s.t = e.t
""")
def regular_grid_all(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("t")).agg(F.min("value").alias("v"))
    return S.to_regular_grid(e, "t", "1 HOUR", ["v"], ["event_type"]).select("event_type", F.col("t").cast("timestamp_ntz").alias("t"), "v")


@query(f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY i DESC) AS k FROM ({_DAILY}))
SELECT event_type, CAST(step AS INTEGER) AS step, n AS forecast FROM d CROSS JOIN range(1, 11) t(step) WHERE k <= 7 AND (step - 1) % 7 = 7 - k
""")
def seasonal_naive(spark, sf_dir):
    return S.naive_forecast(daily(spark, sf_dir), "n", "i", 10, 7, ["event_type"])


@query(f"""
WITH d AS ({_DAILY}), g AS (SELECT event_type, n - lag(n, 2) OVER (PARTITION BY event_type ORDER BY i) AS e FROM d WHERE i < 20), b AS (SELECT event_type, avg(abs(e)) AS a, avg(e * e) AS s FROM g GROUP BY 1), o AS (SELECT event_type, avg(abs(n - i)) AS a, avg((n - i) * (n - i)) AS s FROM d WHERE i >= 20 GROUP BY 1)
SELECT o.event_type, o.a / nullif(b.a, 0) AS mase, sqrt(o.s / nullif(b.s, 0)) AS rmsse FROM o JOIN b ON o.event_type = b.event_type
""")
def scaled_errors(spark, sf_dir):
    d = daily(spark, sf_dir)
    return S.scaled_errors(d.where("i >= 20"), d.where("i < 20"), "n", "i", "i", 2, ["event_type"])


@query("WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS c FROM orders) SELECT CASE WHEN r <= c // 2 THEN 1 ELSE 2 END AS half, count(*) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std FROM o GROUP BY 1")
def half_split(spark, sf_dir):
    return S.half_split(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderdate", "o_orderkey"])


@query("WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS t FROM orders) SELECT * FROM o WHERE NOT (t + 30 >= 2500 AND t < 2500) AND NOT (t > 2600 AND t <= 2630)")
def purge_and_embargo(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long").alias("t"))
    return S.purge_and_embargo(o, "t", 2500, 2600, 30)


@query("WITH o AS (SELECT date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS t FROM orders), a AS (SELECT count(*) AS n, count(*) FILTER (t + 30 >= 2500 AND t < 2500) AS p, count(*) FILTER (t > 2600 AND t <= 2610) AS e FROM o) SELECT n AS n_train_before, p AS n_purged, e AS n_embargoed, n - p - e AS n_train_after, (p + e) / n AS fraction_dropped FROM a")
def purge_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long").alias("t"))
    return S.purge_report(o, "t", 2500, 2600, 30, 10)


_MONTHS = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1"


def _months(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).cast("date").alias("month")).agg(F.sum("o_totalprice").alias("total"))


@query(f"SELECT month, (total - lag(total, 12) OVER w) / lag(total, 12) OVER w AS total_pct12 FROM ({_MONTHS}) WINDOW w AS (ORDER BY month)")
def year_over_year(spark, sf_dir):
    return S.percent_change(_months(spark, sf_dir), "total", 12, ["month"]).select("month", "total_pct12")


@query("WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT a.user_id, a.event_id, b.value AS value_reversed FROM r a JOIN r b ON a.user_id = b.user_id AND b.r = a.n + 1 - a.r")
def reversed_column(spark, sf_dir):
    return S.reversed_column(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "value", ["event_id"], ["user_id"]).select("user_id", "event_id", "value_reversed")


@query("SELECT sum((p_size % 5 + 1) / 5.0 * p_retailprice) / sum(p_retailprice) AS wrmsse FROM part")
def weighted_errors(spark, sf_dir):
    return S.weighted_errors(table(spark, sf_dir, "part").withColumn("e", (F.col("p_size") % 5 + 1) / 5), "e", "p_retailprice")


@query(f"SELECT month, last_day(month) AS month_end, date_diff('day', month, last_day(month)) + 1 AS days, CAST(date_trunc('quarter', month) AS DATE) AS quarter, CAST(month + INTERVAL 3 MONTH AS DATE) AS three_on FROM ({_MONTHS})")
def month_ends(spark, sf_dir):
    m = F.col("month")
    return _months(spark, sf_dir).select("month", F.last_day(m).alias("month_end"), (F.datediff(F.last_day(m), m) + 1).cast("long").alias("days"), F.trunc(m, "quarter").alias("quarter"), F.add_months(m, 3).alias("three_on"))


@query("SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS business_date FROM events")
def business_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts").cast("timestamp_ntz")).cast("date").alias("business_date"))
