"""Features, splits, thresholds and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ratio, signed_log
from ..operators import decisions as D
from ..operators import features as X
from ..operators import statistics as S
from ..registry import query
from ..sources.tables import table


@query("SELECT c_custkey, c_acctbal / coalesce(nullif(CAST(c_nationkey AS DOUBLE), 0), 1e-9) AS r, sign(c_acctbal) * ln(1 + abs(c_acctbal)) AS l FROM customer")
def ratio_and_log(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", ratio("c_acctbal", "c_nationkey").alias("r"), signed_log("c_acctbal").alias("l"))


@query("SELECT p_partkey, (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2) / count(*) OVER () AS r FROM part")
def rank_transform(spark, sf_dir):
    return S.rank_transform(table(spark, sf_dir, "part"), "p_size", "r").select("p_partkey", "r")


@query("SELECT s_suppkey, (SELECT count(*) FILTER (c_acctbal <= s_acctbal) * 1.0 / count(*) FROM customer) AS p FROM supplier")
def ecdf(spark, sf_dir):
    return X.ecdf(table(spark, sf_dir, "customer").withColumnRenamed("c_acctbal", "b"), table(spark, sf_dir, "supplier").withColumnRenamed("s_acctbal", "b"), "b", "p").select("s_suppkey", "p")


@query("SELECT 'c_acctbal' AS \"column\", avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd FROM customer UNION ALL SELECT 'c_nationkey', avg(c_nationkey), stddev_samp(c_nationkey) FROM customer")
def normal_state(spark, sf_dir):
    return X.fit_normal(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"])


@query()
def normal_cdf_features(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return X.apply_normal(X.fit_normal(c, ["c_acctbal"]), c, ["c_acctbal"]).select("c_custkey", "c_acctbal_cdf")


_LIST = "'(' || CASE WHEN p_size % 2 = 0 THEN 'A; b' ELSE ' c | A ' END || CASE WHEN p_size % 5 = 0 THEN ',D)' ELSE ')' END"


@query(f"WITH s AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(trim({_LIST}, '()'), '[;,|]'), lambda x: lower(trim(x))), lambda x: x <> '') AS i FROM part) SELECT p_partkey, CAST(list_contains(i, 'a') AS INTEGER) AS cat__a, CAST(list_contains(i, 'b') AS INTEGER) AS cat__b, CAST(len(i) AS INTEGER) AS cat__count, CAST(len(list_filter(i, lambda x: x NOT IN ('a', 'b'))) > 0 AS INTEGER) AS cat__unknown FROM s")
def multi_hot(spark, sf_dir):
    s = F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("("), F.when(s % 2 == 0, "A; b").otherwise(" c | A "), F.when(s % 5 == 0, ",D)").otherwise(")")).alias("l"))
    return X.apply_multi_hot(["a", "b"], p, "l").drop("l")


_T = "SELECT o_orderkey, o_orderpriority AS c, CAST(o_orderstatus = 'F' AS DOUBLE) AS y, CAST(o_orderkey % 5 AS INTEGER) AS f FROM orders"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("c"), (F.col("o_orderstatus") == "F").cast("double").alias("y"), (F.col("o_orderkey") % 5).cast("int").alias("f"))


@query(f"""
WITH t AS ({_T}), g AS (SELECT f, (SELECT avg(y) FROM t u WHERE u.f <> t.f) AS prior FROM t GROUP BY f), k AS (SELECT c, f, sum(y) AS s, count(*) AS n FROM t GROUP BY ALL), o AS (SELECT c, f, sum(s) OVER (PARTITION BY c) - s AS s, sum(n) OVER (PARTITION BY c) - n AS n FROM k)
SELECT t.o_orderkey, (o.s + 10 * prior) / (o.n + 10) AS encoded FROM t JOIN o ON t.c = o.c AND t.f = o.f JOIN g ON t.f = g.f
""")
def oof_target_encoding(spark, sf_dir):
    return X.oof_target_encode(_orders(spark, sf_dir), "c", "y", "f").select("o_orderkey", "encoded")


@query(f"SELECT c, (sum(y) + 10 * (SELECT avg(y) FROM ({_T}))) / (count(*) + 10) AS encoded, (SELECT avg(y) FROM ({_T})) AS prior FROM ({_T}) GROUP BY c")
def target_encoding(spark, sf_dir):
    return X.fit_target(_orders(spark, sf_dir), "c", "y")


@query("SELECT quality, count(*) AS n, (SELECT count(*) FROM labels) * 1.0 / ((SELECT count(DISTINCT quality) FROM labels) * count(*)) AS weight FROM labels GROUP BY 1")
def class_weights(spark, sf_dir):
    return X.class_weights(table(spark, sf_dir, "labels"), "quality")


@query("SELECT lang, count(*) AS n, count(DISTINCT md5(text)) AS n_distinct, 1 - count(DISTINCT md5(text)) * 1.0 / count(*) AS duplicate_rate FROM documents GROUP BY 1")
def class_duplicates(spark, sf_dir):
    return X.class_duplicates(table(spark, sf_dir, "documents").select("lang", F.md5("text").alias("t")), "lang", ["t"])


@query("SELECT toxic, CASE WHEN toxic = 1 THEN count(*) ELSE (SELECT count(*) FROM labels WHERE toxic = 1) * 2 END AS n FROM labels GROUP BY 1")
def undersample(spark, sf_dir):
    return X.resample(table(spark, sf_dir, "labels"), "doc_id", "toxic", 0.5).groupBy("toxic").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT toxic, CASE WHEN toxic = 0 THEN n ELSE greatest(n, CAST(round_even((SELECT n FROM c WHERE toxic = 0) * 0.5, 0) AS BIGINT)) END AS n FROM c")
def oversample(spark, sf_dir):
    return X.resample(table(spark, sf_dir, "labels"), "doc_id", "toxic", 0.5, "over").groupBy("toxic").agg(F.count("*").alias("n"))


@query("SELECT quality, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test, count(*) - CAST(round(count(*) * 0.2) AS BIGINT) AS n_train FROM labels GROUP BY 1")
def stratified_split(spark, sf_dir):
    return X.make_split(table(spark, sf_dir, "labels"), "doc_id", "stratified", stratify="quality").groupBy("quality").agg(F.count_if(F.col("split") == "test").alias("n_test"), F.count_if(F.col("split") == "train").alias("n_train"))


@query("WITH c AS (SELECT quantile_cont(epoch(o_orderdate), 0.8) AS c FROM orders) SELECT o_orderkey, CASE WHEN epoch(o_orderdate) > c THEN 'test' ELSE 'train' END AS split FROM orders, c")
def chronological_split(spark, sf_dir):
    return X.make_split(table(spark, sf_dir, "orders"), "o_orderkey", "chronological", time_col="o_orderdate").select("o_orderkey", "split")


@query("SELECT 0::BIGINT AS n_shared, count(DISTINCT o_custkey) AS n_groups FROM orders")
def group_split(spark, sf_dir):
    s = X.make_split(table(spark, sf_dir, "orders"), "o_orderkey", "group", group="o_custkey").groupBy("o_custkey").agg(F.count_distinct("split").alias("k"))
    return s.agg(F.count_if(F.col("k") > 1).alias("n_shared"), F.count("*").alias("n_groups"))


@query("SELECT 'p_size' AS \"column\", count(DISTINCT p_size) AS n_unique, var_samp(p_size) AS variance, false AS flagged FROM part UNION ALL SELECT 'one', 1, 0, true")
def constant_columns(spark, sf_dir):
    return X.constant_columns(table(spark, sf_dir, "part").withColumn("one", F.lit(1)), ["p_size", "one"])


@query("SELECT 'again' AS \"column\", 'p_size' AS same_as")
def duplicate_columns(spark, sf_dir):
    return X.duplicate_columns(table(spark, sf_dir, "part").withColumn("again", F.col("p_size")), ["p_partkey", "p_size", "p_retailprice", "again"])


_Y = "SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, floor(o_totalprice / 10000) AS s FROM orders"
_SWEEP = f"""WITH d AS ({_Y}), t AS (SELECT DISTINCT s AS threshold FROM d UNION ALL SELECT 'infinity'::DOUBLE), w AS (SELECT threshold, sum(y) FILTER (s >= threshold) AS tp, count(*) FILTER (s >= threshold AND y = 0) AS fp, sum(y) AS p, count(*) - sum(y) AS n FROM t, d GROUP BY threshold), sw AS (
SELECT threshold, CAST(coalesce(tp, 0) AS BIGINT) AS tp, fp, CAST(p - coalesce(tp, 0) AS BIGINT) AS fn, CAST(n - fp AS BIGINT) AS tn, coalesce(tp, 0) / p AS tpr, fp / n AS fpr, tp / nullif(tp + fp, 0) AS precision, coalesce(tp, 0) / p - fp / n AS youden, (coalesce(tp, 0) / p + 1 - fp / n) / 2 AS balanced FROM w)"""


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("s"))


def _sweep(spark, sf_dir):
    return D.sweep(_scored(spark, sf_dir), "y", "s")


@query(_SWEEP + " SELECT * FROM sw")
def threshold_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query(_SWEEP + " SELECT 'youden' AS criterion, * FROM (SELECT * FROM sw ORDER BY round(youden, 12) DESC, threshold LIMIT 1) UNION ALL SELECT 'closest01', * FROM (SELECT * FROM sw ORDER BY round(fpr * fpr + (1 - tpr) * (1 - tpr), 12), threshold LIMIT 1)")
def threshold_picks(spark, sf_dir):
    s = _sweep(spark, sf_dir)
    return D.pick(s, "youden").unionByName(D.pick(s, "closest01"))


@query(_SWEEP + " SELECT sum((fpr - px) * (tpr + py) / 2) AS auc FROM (SELECT fpr, tpr, lag(fpr, 1, 0) OVER w AS px, lag(tpr, 1, 0) OVER w AS py FROM sw WINDOW w AS (ORDER BY threshold DESC))")
def auc(spark, sf_dir):
    return D.auc(_scored(spark, sf_dir), "y", "s")


@query("""
WITH s AS (SELECT o_totalprice AS s, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS p, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT s, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS a, sum(p) OVER () AS pa, sum(n) OVER () AS na FROM s WINDOW w AS (ORDER BY s DESC)),
r AS (SELECT max(pa) / max(na) AS prevalence, arg_max(tp / a, s) FILTER (tp >= 0.5 * pa) AS h, arg_max(tp / a, s) FILTER (tp >= 0.8 * pa) AS e, sum(p / pa * tp / a) AS average_precision, sum((n - p) * (tp - p / 2.0)) / (max(pa) * max(na - pa)) AS auc FROM c)
SELECT prevalence, h AS precision_at_50, e AS precision_at_80, average_precision, auc, 1 / h AS alerts_per_hit_at_50, 1 / e AS alerts_per_hit_at_80 FROM r
""")
def prevalence_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return D.prevalence_report(o.select((F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_totalprice"), "y", "o_totalprice")


@query("WITH c AS (SELECT quality AS a, 1 - toxic AS b FROM labels), p AS (SELECT count(*) AS n, avg(CAST(a = b AS INTEGER)) AS po, avg(a) AS pa, avg(b) AS pb FROM c) SELECT n, po AS agreement, (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) AS kappa FROM p")
def kappa(spark, sf_dir):
    return D.kappa(table(spark, sf_dir, "labels").withColumn("b", 1 - F.col("toxic")), "quality", "b")


@query("""
WITH r AS (SELECT o_orderkey AS item, unnest([o_orderkey % 3, o_orderkey % 4, length(o_orderpriority) % 3]) AS c FROM orders), k AS (SELECT item, c, count(*) AS n FROM r GROUP BY ALL), p AS (SELECT avg(q) AS p, count(*) AS items FROM (SELECT item, sum(n * (n - 1)) / 6.0 AS q FROM k GROUP BY 1)), e AS (SELECT sum(s * s) AS e FROM (SELECT sum(n) / (SELECT sum(n) FROM k) AS s FROM k GROUP BY c))
SELECT items, (p - e) / (1 - e) AS kappa FROM p, e
""")
def fleiss_kappa(spark, sf_dir):
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(k.alias("item"), F.explode(F.array(k % 3, k % 4, (F.length("o_orderpriority") % 3).cast("long"))).alias("c"))
    return D.fleiss(r, "item", "c")


@query("SELECT s_suppkey, (s_acctbal - s_nationkey * 300) / abs(s_acctbal) AS gap, CASE WHEN (s_acctbal - s_nationkey * 300) / abs(s_acctbal) < 0 THEN 'anomaly' WHEN (s_acctbal - s_nationkey * 300) / abs(s_acctbal) < 0.15 THEN 'fine' WHEN (s_acctbal - s_nationkey * 300) / abs(s_acctbal) < 0.2 THEN 'watch' WHEN (s_acctbal - s_nationkey * 300) / abs(s_acctbal) < 0.3 THEN 'overfit' ELSE 'severe' END AS verdict FROM supplier")
def generalisation_gap(spark, sf_dir):
    return D.generalisation_gap(table(spark, sf_dir, "supplier").withColumn("t", F.col("s_nationkey") * 300), "s_acctbal", "t").select("s_suppkey", "gap", "verdict")


@query("WITH g AS (SELECT source, sum(quality) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT source, (k + 1) / (n + 2) AS posterior_mean, sqrt((k + 1) * (n - k + 1) / ((n + 2) * (n + 2) * (n + 3))) AS posterior_sd FROM g")
def beta_posterior(spark, sf_dir):
    g = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    return D.beta_posterior(g, "k", "n").select("source", "posterior_mean", "posterior_sd")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity % 7 = 0 AS INTEGER) AS tax_isna, CAST(l_quantity % 5 = 0 OR l_quantity % 7 = 0 AS INTEGER) AS discount_isna FROM lineitem")
def missing_indicator(spark, sf_dir):
    from .quality import holes

    return X.missing_indicator(holes(spark, sf_dir), ["tax", "discount"]).select("l_orderkey", "l_linenumber", "l_partkey", "tax_isna", "discount_isna")


@query("SELECT p_name AS feature, max(DATE '2020-01-01' + CAST(p_size AS INTEGER)) > DATE '2020-02-10' AS leaky FROM part GROUP BY 1")
def availability_audit(spark, sf_dir):
    import datetime

    known = table(spark, sf_dir, "part").groupBy("p_name").agg(F.max(F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size").cast("int"))).alias("at"))
    return X.availability_audit(known, "p_name", "at", datetime.date(2020, 2, 10))
