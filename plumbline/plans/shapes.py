"""Shapes of columns, and probes by models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import shapes as H
from ..operators import statistics as S
from ..registry import query
from ..sources.tables import cut_lineage, table


@query("WITH r AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice DESC) AS r, count(*) OVER () AS n FROM orders WHERE o_totalprice > 0), k AS (SELECT n, CAST(floor(n * 0.1) AS BIGINT) AS k FROM r LIMIT 1) SELECT k.n, k.k, 1 / (avg(ln(x)) FILTER (r <= k.k) - ln(max(x) FILTER (r = k.k + 1))) AS hill_alpha FROM r, k GROUP BY k.n, k.k")
def tail_index(spark, sf_dir):
    return H.tail_index(table(spark, sf_dir, "orders"), "o_totalprice")


_SIG = "SELECT count(*) AS n, count(DISTINCT x) AS n_unique, min(x) AS least, max(x) AS greatest, bool_and(x = floor(x)) AS whole, bool_and(x >= 0) AS non_negative, bool_and(x BETWEEN 0 AND 1) AS unit, avg(CASE WHEN x = 0 THEN 1.0 ELSE 0 END) AS zero_share, avg(pow(x - m, 3)) / pow(stddev_pop(x), 3) AS skew, avg(pow(x - m, 4)) / pow(stddev_pop(x), 4) - 3 AS kurtosis, var_samp(x) / avg(x) AS variance_over_mean FROM (SELECT value AS x FROM events), (SELECT avg(value) AS m FROM events)"


@query(_SIG)
def value_signature(spark, sf_dir):
    return H.signature(table(spark, sf_dir, "events"), "value")


@query("SELECT * FROM (VALUES (1, 'lognormal'), (2, 'gamma'), (3, 'weibull'), (4, 'pareto'), (5, 'exponential')) t(rank, family)")
def candidate_families(spark, sf_dir):
    return H.families(H.signature(table(spark, sf_dir, "events").withColumn("v", F.exp(F.col("value") % 7)), "v"))


@query("""
WITH d AS (SELECT o_totalprice AS x FROM orders), m AS (SELECT median(x) AS m FROM d), a AS (SELECT count(*) AS n, avg(x) AS mu, var_pop(x) AS v, avg(abs(x - m)) AS b, avg(ln(x)) AS lm, var_pop(ln(x)) AS lv FROM d, m), l AS (
SELECT 'normal' AS family, -n / 2 * (ln(2 * pi()) + ln(v) + 1) AS ll, 2 AS p FROM a UNION ALL SELECT 'laplace', -n * (ln(2 * b) + 1), 2 FROM a UNION ALL SELECT 'lognormal', -n / 2 * (ln(2 * pi()) + ln(lv) + 1) - n * lm, 2 FROM a UNION ALL SELECT 'exponential', -n * (ln(mu) + 1), 1 FROM a)
SELECT family, ll AS log_likelihood, 2 * p - 2 * ll AS aic FROM l
""")
def fit_rank(spark, sf_dir):
    return H.fit_rank(table(spark, sf_dir, "orders"), "o_totalprice")


@query("WITH s AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS z FROM customer), n AS (SELECT least(9, CAST(floor((c_acctbal - a) / (z - a) * 10) AS BIGINT)) AS bin, count(*) AS n FROM customer, s GROUP BY 1) SELECT bin, coalesce(n, 0) AS n FROM range(0, 10) t(bin) LEFT JOIN n USING (bin)")
def histogram(spark, sf_dir):
    return H.histogram(table(spark, sf_dir, "customer"), "c_acctbal", 10)


@query()
def histogram_modes(spark, sf_dir):
    return H.modes(table(spark, sf_dir, "customer"), "c_acctbal")


_RTM = "SELECT l_extendedprice AS b, l_extendedprice * 0.5 + l_quantity * 100 AS f FROM lineitem"


@query(f"WITH d AS ({_RTM}), t AS (SELECT quantile_cont(b, 0.1) AS t FROM d), a AS (SELECT count(*) FILTER (b <= t) AS n_selected, avg(f - b) FILTER (b <= t) AS change, avg(b) FILTER (b <= t) AS sb, regr_slope(f, b) FILTER (b > t) AS k, regr_intercept(f, b) FILTER (b > t) AS i FROM d, t) SELECT n_selected, change, i + k * sb - sb AS expected, change - (i + k * sb - sb) AS excess FROM a")
def regression_to_mean(spark, sf_dir):
    b = F.col("l_extendedprice")
    return H.regression_to_mean(table(spark, sf_dir, "lineitem").select(b.alias("b"), (b * 0.5 + F.col("l_quantity") * 100).alias("f")), "b", "f")


@query("WITH c AS (SELECT median(l_quantity) AS c FROM lineitem), a AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r_before, corr(CAST(l_quantity > c AS DOUBLE), l_extendedprice) AS r_after FROM lineitem, c) SELECT *, pow(r_after / r_before, 2) AS kept, 2 / pi() AS theory FROM a")
def dichotomization_cost(spark, sf_dir):
    return H.dichotomization_cost(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@query("SELECT p_partkey, 0.3 / sqrt((0.5 + p_size / 200.0) * 0.8) AS disattenuated, sqrt((0.5 + p_size / 200.0) * 0.8) AS ceiling, 0.3 * (2 + p_size / 50.0) / sqrt(1 + 0.09 * (pow(2 + p_size / 50.0, 2) - 1)) AS corrected FROM part")
def scalar_corrections(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit(0.3).alias("r"), (0.5 + F.col("p_size") / 200.0).alias("x"), F.lit(0.8).alias("y"), F.lit(1.0).alias("s"), (2 + F.col("p_size") / 50.0).alias("t"))
    return H.range_restriction(H.scalar_corrections(p, "r", "x", "y"), "r", "s", "t").select("p_partkey", "disattenuated", "ceiling", "corrected")


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.size(F.split("text", " ")).alias("n_words"), F.length(F.regexp_replace("text", "[A-Za-z ]", "")).alias("n_other"))
    # written, so that the texts are read once, whatever is fitted to the numbers
    return cut_lineage(d.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("leak", F.col("quality") + F.col("doc_id") % 2 * 0.1))


NAMES = ["n_chars", "n_words", "n_other"]


@query()
def single_feature_auc(spark, sf_dir):
    return M.single_feature_auc(_labelled(spark, sf_dir), "doc_id", "quality", ["leak", "n_other"], folds=3)


@query()
def separability(spark, sf_dir):
    return M.separability(M.assembled(_labelled(spark, sf_dir), NAMES), "doc_id", "quality", 3)


@query()
def suspect_labels(spark, sf_dir):
    return M.suspect_labels(M.assembled(_labelled(spark, sf_dir), [*NAMES, "leak"]).withColumn("quality", F.when(F.col("doc_id") % 40 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))), "doc_id", "quality", 0.7, 3)


@query()
def missingness_auc(spark, sf_dir):
    return M.missingness_auc(_labelled(spark, sf_dir).withColumn("gone", F.when(F.col("n_chars") > 500, F.col("n_words"))), "doc_id", "gone", NAMES)


@query()
def forest_importance(spark, sf_dir):
    return M.forest_importance(_labelled(spark, sf_dir), "quality", [*NAMES, "leak"], 20)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query()
def k_scan(spark, sf_dir):
    return M.k_scan(_vectors(spark, sf_dir), [2, 4, 8])


@query()
def cluster_stability(spark, sf_dir):
    return M.cluster_stability(_vectors(spark, sf_dir), "vec_id", 4, 2)


@query("""
WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM c GROUP BY b)), e AS (SELECT *, x * y / (t * (t - 1) / 2) AS e FROM i, x, y)
SELECT (i - e) / ((x + y) / 2 - e) AS ari FROM e
""")
def adjusted_rand(spark, sf_dir):
    return M.adjusted_rand(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query()
def mrmr(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    names = ["l_quantity", "l_discount", "l_tax"]
    rel = S.correlation_matrix(items, [*names, "l_extendedprice"]).where("b = 'l_extendedprice'").select(F.col("a").alias("column"), F.abs("r").alias("score"))
    return M.mrmr(rel, S.correlation_matrix(items, names), 3)


@query()
def permutation_importance(spark, sf_dir):
    return M.permutation_importance_oof(_labelled(spark, sf_dir), "doc_id", "quality", NAMES)


@query()
def null_target_importance(spark, sf_dir):
    return M.null_target_importance(_labelled(spark, sf_dir), "doc_id", "quality", NAMES, 3)


@query()
def feature_elimination(spark, sf_dir):
    return M.rfe_select(_labelled(spark, sf_dir), "quality", NAMES, 1)


@query()
def anomalous_clusters(spark, sf_dir):
    return M.anomalous_clusters(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), "c_custkey", ["c_acctbal", "c_nationkey"])[0]


@query()
def intelligent_k_means(spark, sf_dir):
    return M.ik_means(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), "c_custkey", ["c_acctbal", "c_nationkey"])
