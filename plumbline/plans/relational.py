"""Filters, joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import fixed_text, is_kebab, slug
from ..operators import relational as R
from ..registry import query
from ..sources.tables import table, upserted

LATE = "TIMESTAMP '2024-01-10'"


@query("SELECT event_type, user_id, count(*) AS n, grouping(user_id) = 1 AS is_total FROM events GROUP BY GROUPING SETS ((event_type, user_id), (event_type))")
def usage_stats(spark, sf_dir):
    return R.usage_stats(R.accepted(table(spark, sf_dir, "events"), is_kebab("event_type")).where("ok"), "user_id", "event_type")


@query("""SELECT event_id, coalesce(regexp_full_match(event_type, '[a-z0-9]+(-[a-z0-9]+)*') AND length(event_type) <= 64 AND value BETWEEN 0 AND 100, false) AS ok FROM events""")
def accepted_events(spark, sf_dir):
    return R.accepted(table(spark, sf_dir, "events"), is_kebab("event_type") & F.col("value").between(0, 100)).select("event_id", "ok")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, greatest(0, value - 10) AS net, CASE WHEN value >= 50 THEN 'high' WHEN value < 5 THEN 'low' ELSE 'middle' END AS band, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def derived_columns(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.substring(F.col("ts").cast("string"), 1, 10).alias("day"), F.greatest(F.lit(0.0), F.col("value") - 10).alias("net"), F.when(F.col("value") >= 50, "high").when(F.col("value") < 5, "low").otherwise("middle").alias("band"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT l_returnflag, coalesce(avg(l_tax), 0) AS mean, coalesce(stddev_samp(l_tax), 0) AS std, min(l_tax) AS least, max(l_tax) AS greatest, count(l_tax) AS n FROM lineitem GROUP BY ALL")
def basic_stats(spark, sf_dir):
    return R.stats(table(spark, sf_dir, "lineitem"), "l_tax", ["l_returnflag"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_order(spark, sf_dir):
    return R.first_wins(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_event(spark, sf_dir):
    return R.last_per_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""
WITH e AS (SELECT * FROM events WHERE event_type <> 'purchase'), p AS (SELECT user_id, ts, max(value) AS last_price FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, p.last_price FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts
""")
def as_of_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return R.as_of(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'").withColumnRenamed("value", "last_price"), "user_id", "ts", "ts", ["last_price"]).select("event_id", "last_price")


VERSIONS = "SELECT o_custkey, o_orderpriority, o_orderdate, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS b FROM (SELECT o_custkey, o_orderdate, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY ALL)"


def _versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderpriority").alias("o_orderpriority"))
    return R.intervals(o, "o_custkey", "o_orderdate", ["o_orderpriority"])


@query(f"SELECT o_custkey, o_orderpriority, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS valid_to FROM ({VERSIONS}) WHERE b IS NULL OR b <> o_orderpriority")
def version_intervals(spark, sf_dir):
    return _versions(spark, sf_dir)


@query(f"""
WITH v AS (SELECT o_custkey, o_orderpriority, o_orderdate AS f, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS t FROM ({VERSIONS}) WHERE b IS NULL OR b <> o_orderpriority)
SELECT e.event_id, v.o_orderpriority FROM events e LEFT JOIN v ON e.user_id = v.o_custkey AND e.ts >= v.f AND (v.t IS NULL OR e.ts < v.t)
""")
def valid_at_join(spark, sf_dir):
    v = _versions(spark, sf_dir).withColumnRenamed("o_custkey", "user_id")
    return R.valid_at(table(spark, sf_dir, "events"), v, "user_id", "ts", "valid_from", "valid_to", ["o_orderpriority"]).select("event_id", "o_orderpriority")


_SPANS = "SELECT o_orderkey AS id, o_custkey AS k, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS b, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 30 AS e FROM orders"


def _spans(spark, sf_dir):
    day = F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), day.alias("b"), (day + 30).alias("e"))


@query(f"WITH s AS ({_SPANS}) SELECT x.k, x.id AS a, y.id AS b FROM s x JOIN s y ON x.k = y.k AND x.id < y.id AND x.b < y.e AND y.b < x.e")
def interval_overlaps(spark, sf_dir):
    return R.overlaps(_spans(spark, sf_dir), ["k"], "id", "b", "e", 30)


@query(f"""
WITH s AS ({_SPANS}), m AS (SELECT k, b AS t, 1 AS d FROM s UNION ALL SELECT k, e, -1 FROM s), w AS (SELECT k, sum(d) OVER (PARTITION BY k ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS c FROM m)
SELECT k, CAST(max(c) AS BIGINT) AS max_open FROM w GROUP BY k
""")
def max_concurrency(spark, sf_dir):
    return R.max_concurrency(_spans(spark, sf_dir), ["k"], "b", "e")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_acctbal > 0)")
def referential_integrity(spark, sf_dir):
    return R.missing_targets(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").where("s_acctbal > 0"), "l_suppkey", "s_suppkey").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    c = table(spark, sf_dir, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query("""
WITH a AS (SELECT p_brand, row_number() OVER (ORDER BY avg(p_retailprice) DESC, p_brand) AS r FROM part WHERE p_size < 25 GROUP BY p_brand), b AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part WHERE p_size > 40 GROUP BY p_brand)
SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) AS score FROM a FULL JOIN b ON a.p_brand = b.p_brand
""")
def fused_ranks(spark, sf_dir):
    from pyspark.sql.window import Window

    p = table(spark, sf_dir, "part")
    ranked = lambda d, o: d.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("v"), "p_brand")))  # noqa: E731, ARG005
    a = ranked(p.where("p_size < 25").groupBy("p_brand").agg(F.avg("p_retailprice").alias("v")), 0)
    b = ranked(p.where("p_size > 40").groupBy("p_brand").agg(F.count("*").alias("v")), 0)
    return R.fused_ranks(a, b, "p_brand", "r")


@query("""
WITH m AS (SELECT l_suppkey, year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY ALL), a AS (SELECT * FROM m WHERE y = 1996), b AS (SELECT * FROM m WHERE y = 1997)
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, a.n AS before, b.n AS after, b.n - a.n AS delta FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey
""")
def aligned_series(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"))
    return R.aligned(m.where("y = 1996"), m.where("y = 1997"), ["l_suppkey"], "n")


@query("""
WITH t AS (SELECT o_custkey AS node, o_orderpriority = '1-URGENT' AS c, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS rate, avg(o_totalprice) AS cost FROM orders GROUP BY ALL), x AS (SELECT * FROM t WHERE c), y AS (SELECT * FROM t WHERE NOT c)
SELECT coalesce(x.node, y.node) AS node, concat_ws(',', CASE WHEN x.n IS NULL OR y.n IS NULL THEN 'missing_data' END, CASE WHEN x.rate = 1 AND y.rate = 1 THEN 'non_discriminating' END, CASE WHEN x.rate = 0 AND y.rate = 0 THEN 'always_failing' END, CASE WHEN (x.rate > 0.2 AND x.rate < 0.8) OR (y.rate > 0.2 AND y.rate < 0.8) THEN 'flaky' END, CASE WHEN x.cost > 1.25 * y.cost THEN 'cost_regression' END) AS flags
FROM x FULL JOIN y ON x.node = y.node
""")
def run_flags(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node"), (F.col("o_orderpriority") == "1-URGENT").alias("c")).agg(F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"), F.avg("o_totalprice").alias("cost"))
    return R.flags(o.where("c"), o.where("NOT c"), "node")


@query("""
WITH w AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS w FROM events), f AS (SELECT *, min(w) OVER (PARTITION BY user_id) AS cohort FROM w)
SELECT cohort, CAST(date_diff('day', cohort, w) / 7 AS INTEGER) AS week, count(*) AS entities FROM f GROUP BY ALL
""")
def cohort_retention(spark, sf_dir):
    return R.retention(table(spark, sf_dir, "events"), "user_id", "ts")


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY 1), r AS (SELECT * FROM d ORDER BY day DESC LIMIT 14)
SELECT CAST((SELECT sum(n) FROM d) AS BIGINT) AS all_n, CAST((SELECT sum(u) FROM d) AS BIGINT) AS all_u, CAST((SELECT sum(n) FROM r) AS BIGINT) AS recent_n, CAST((SELECT sum(u) FROM r) AS BIGINT) AS recent_u
""")
def recent_totals(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u"))
    return R.recent_totals(d, "day", ["n", "u"], 14)


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot_counts(spark, sf_dir):
    return R.pivoted(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1))).na.fill(0)


@query("SELECT p_partkey, unnest(['p_size', 'p_retailprice']) AS name, unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS value FROM part")
def unpivot_measures(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double"), "p_retailprice").unpivot("p_partkey", ["p_size", "p_retailprice"], "name", "value")


@query("WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events), g AS (SELECT *, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g FROM d) SELECT user_id, min(d) AS first, max(d) AS last, count(*) AS length FROM g GROUP BY user_id, g")
def gaps_and_islands(spark, sf_dir):
    return R.islands(table(spark, sf_dir, "events").select("user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01")).cast("long").alias("d")), ["user_id"], "d")


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 3")
def top_per_group(spark, sf_dir):
    return R.top_per_group(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "rank")


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50)")
def keyset_page(spark, sf_dir):
    return R.keyset_page(table(spark, sf_dir, "orders"), "o_orderkey", 500, 50).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2)::DOUBLE AS total, grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("p", F.col("o_totalprice").cast("decimal(18,2)"))
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("p").cast("double").alias("total"), F.grouping_id().alias("level"))


@query("SELECT r_name, n_name, count(*) AS n, grouping(r_name) * 2 + grouping(n_name) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_totals(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def ordered_names(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.expr("listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name)").alias("names"))


@query("WITH l AS (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) SELECT o_custkey, sum(o_totalprice) > 100000 AS big, count(*) AS orders, CAST(sum(lines) AS BIGINT) AS lines, sum(qty) AS qty FROM orders JOIN l ON l_orderkey = o_orderkey GROUP BY 1")
def fan_out_safe(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")  # noqa: E741
    s = l.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("qty"))
    return o.join(s, o["o_orderkey"] == s["l_orderkey"]).groupBy("o_custkey").agg((F.sum("o_totalprice") > 100000).alias("big"), F.count("*").alias("orders"), F.sum("lines").alias("lines"), F.sum("qty").alias("qty"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 3 ORDER BY kinds DESC, user_id LIMIT 12")
def shared_contexts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds")).where("kinds >= 3").orderBy(F.desc("kinds"), "user_id").limit(12)


@query("(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_operations(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = lambda cond: o.where(cond).select(F.col("o_custkey").alias("k"))
    return k("o_orderstatus = 'F'").intersect(k("o_orderstatus = 'P'")).subtract(k("o_orderpriority = '1-URGENT'")).union(c.where("c_acctbal < 0").select("c_custkey")).distinct()


@query("SELECT s_suppkey AS id, s_name AS name, 'supplier' AS kind FROM supplier UNION ALL SELECT c_custkey, c_name, 'customer' FROM customer UNION ALL SELECT p_partkey, p_name, 'part' FROM part UNION ALL SELECT n_nationkey, n_name, 'nation' FROM nation")
def catalogue_entries(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(i).cast("long").alias("id"), F.col(n).alias("name"), F.lit(t).alias("kind")) for t, i, n in (("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"), ("nation", "n_nationkey", "n_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT p_partkey, coalesce(nullif(left(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), ''), 'case') AS slug FROM part")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query(f"""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, max(event_id) AS seq FROM events GROUP BY ALL), o AS (SELECT * FROM d WHERE day < {LATE}), w AS (SELECT user_id, day, n + 1 AS n, seq FROM d WHERE day >= DATE '2024-01-05')
SELECT coalesce(w.user_id, o.user_id) AS user_id, coalesce(w.day, o.day) AS day, coalesce(w.n, o.n) AS n, coalesce(w.seq, o.seq) AS seq FROM o FULL JOIN w ON o.user_id = w.user_id AND o.day = w.day
""")
def upsert_days(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.max("event_id").alias("seq"))
    return upserted(d.where("day < DATE '2024-01-10'"), d.where("day >= DATE '2024-01-05'").withColumn("n", F.col("n") + 1), ["user_id", "day"], "seq")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS p, n_nationkey AS c FROM nation), w AS (SELECT p AS root, c AS node, [p, c] AS path, 1 AS depth, p = c AS is_cycle FROM e UNION ALL SELECT root, e.c, list_append(path, e.c), depth + 1, list_contains(path, e.c) FROM w JOIN e ON w.node = e.p WHERE NOT is_cycle AND depth < 6)
SELECT root, node, depth, is_cycle FROM w
""")
def hierarchy_paths(spark, sf_dir):
    return R.hierarchy_paths(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", 6)


@query("""
SELECT * FROM (VALUES ('late', (SELECT count(*) FILTER (NOT (l_shipdate < TIMESTAMP '2000-01-01')) FROM lineitem), (SELECT avg(CASE WHEN NOT (l_shipdate < TIMESTAMP '2000-01-01') THEN 1.0 ELSE 0 END) FROM lineitem), 0::BIGINT),
 ('discounted', (SELECT count(*) FILTER (nullif(l_discount, 0) < 0.02) FROM lineitem), (SELECT count(*) FILTER (nullif(l_discount, 0) < 0.02) * 1.0 / count(nullif(l_discount, 0)) FROM lineitem), (SELECT count(*) FILTER (l_discount = 0) FROM lineitem)),
 ('broken', NULL, NULL, NULL)) t(rule, violations, rate, unevaluable)
""")
def logical_constraints(spark, sf_dir):
    return R.rules_report(table(spark, sf_dir, "lineitem"), {"late": "l_shipdate < TIMESTAMP_NTZ '2000-01-01'", "discounted": "nullif(l_discount, 0) >= 0.02", "broken": "no_such_column > 1"}).drop("error")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 1000 = 1 THEN NULL ELSE o_custkey END FROM orders) UNION ALL SELECT -1")
def not_in_with_null(spark, sf_dir):
    """NOT IN over a list with a null keeps nothing: the row of -1 shows that the query ran."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 1000 != 1, F.col("o_custkey")).alias("k"))
    out = spark.sql("SELECT c_custkey FROM {c} WHERE c_custkey NOT IN (SELECT k FROM {o})", c=c, o=o)
    return out.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey")))


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 480000)")
def not_exists_correlated(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return spark.sql("SELECT c_custkey FROM {c} c WHERE NOT EXISTS (SELECT 1 FROM {o} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 480000)", c=c, o=o)


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def above_own_average(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {o} o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM {o} i WHERE i.o_custkey = o.o_custkey)", o=o)


@query("SELECT n.n_nationkey, r.r_regionkey, n.n_regionkey IS NOT DISTINCT FROM r.r_regionkey AS same FROM nation n CROSS JOIN region r")
def cross_pairs(spark, sf_dir):
    """Of two tables of fixed size."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.crossJoin(r).select("n_nationkey", "r_regionkey", F.col("n_regionkey").eqNullSafe(F.col("r_regionkey")).alias("same"))


@query("SELECT coalesce(c.k, s.k) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c.k = s.k")
def full_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full_outer")


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def lookup_with_default(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0, ["n_orders"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def offset_page(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query("SELECT p_partkey FROM part ORDER BY md5(p_partkey || ':7'), p_partkey LIMIT 100")
def random_rows(spark, sf_dir):
    """A sample by the hash of the key: the same on every run."""
    return table(spark, sf_dir, "part").select("p_partkey").orderBy(F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit(":7"))), "p_partkey").limit(100)


_DOCUMENT = """'{"id":' || p_partkey || ',"brand":{"name":"' || p_brand || '"},"tags":["' || p_type || '","size ' || p_size || '"]}'"""


@query(f"SELECT CAST(j->>'$.id' AS BIGINT) AS id, j->>'$.brand.name' AS brand, json_array_length(j->'$.tags') AS n_tags, j->>'$.tags[1]' AS second FROM (SELECT CAST({_DOCUMENT} AS JSON) AS j FROM part) WHERE list_contains(CAST(j->'$.tags' AS VARCHAR[]), 'size 7') OR j->>'$.brand.name' = 'Brand#12'")
def nested_find(spark, sf_dir):
    """Documents by a nested field or a member of an array."""
    text = F.concat(F.lit('{"id":'), F.col("p_partkey").cast("string"), F.lit(',"brand":{"name":"'), "p_brand", F.lit('"},"tags":["'), "p_type", F.lit('","size '), F.col("p_size").cast("string"), F.lit('"]}'))
    j = table(spark, sf_dir, "part").select(F.from_json(text, "id long, brand struct<name: string>, tags array<string>").alias("j"))
    return j.where(F.array_contains("j.tags", "size 7") | (F.col("j.brand.name") == "Brand#12")).select("j.id", F.col("j.brand.name").alias("brand"), F.size("j.tags").cast("long").alias("n_tags"), F.col("j.tags")[1].alias("second"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 1000000 THEN printf('%.1fM', o_totalprice / 1000000) WHEN o_totalprice >= 1000 THEN printf('%.1fk', o_totalprice / 1000) ELSE printf('%.0f', o_totalprice) END AS price, printf('%dm%02ds', o_orderkey // 60, o_orderkey % 60) AS duration FROM orders")
def readable_numbers(spark, sf_dir):
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(p >= 1e6, F.concat(fixed_text(p / 1e6, 1), F.lit("M"))).when(p >= 1000, F.concat(fixed_text(p / 1000, 1), F.lit("k"))).otherwise(fixed_text(p, 0)).alias("price"), F.when(k.isNotNull(), F.format_string("%dm%02ds", F.expr("o_orderkey div 60"), k % 60)).alias("duration"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderkey % 3 = 0) AS null_flag, count(*) FILTER (o_orderkey % 3 = 1 AND o_totalprice > 100000) AS both_true, count(*) FILTER (o_orderkey % 3 = 1 OR (o_orderkey % 3 <> 0 AND o_totalprice > 100000) OR o_totalprice > 100000) AS either_true FROM orders GROUP BY 1")
def three_valued_logic(spark, sf_dir):
    """A flag that is null, true or false: AND and OR with a null."""
    f = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 3 == 1)
    big = F.col("o_totalprice") > 100000
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(f.isNull()).alias("null_flag"), F.count_if(f & big).alias("both_true"), F.count_if(f | big).alias("either_true"))


@query("SELECT config, count(*) AS n, avg(ok) AS rate FROM (SELECT coalesce(o_orderpriority, '') AS config, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END AS ok FROM orders) GROUP BY 1")
def by_configuration(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("config")).agg(F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"))


@query("SELECT n_name, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def hinted_joins(spark, sf_dir):
    """The join of two large tables by sorting, that with a table of fixed size by broadcast."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    met = o.select("o_custkey", "o_totalprice").join(c.select("c_custkey", "c_nationkey").hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    return met.join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("SELECT n_name, coalesce(string_agg(s_name, '|' ORDER BY s_name), '') AS suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def lookup_into_documents(spark, sf_dir):
    """Each nation with the list of its suppliers, as a lookup stage embeds them."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_name")).alias("suppliers"))
    return table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce(F.array_join("suppliers", "|"), F.lit("")).alias("suppliers"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def row_counts(spark, sf_dir):
    one = lambda t: table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
    return one("orders").unionByName(one("events"))
