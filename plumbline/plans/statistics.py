"""Association, sampling design, reliability, multivariate diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as S
from ..registry import query
from ..sources.tables import table

_C = "SELECT x, y, n, sum(n) OVER (PARTITION BY x) AS row, sum(n) OVER (PARTITION BY y) AS col, sum(n) OVER () AS total FROM (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS n FROM orders GROUP BY ALL)"
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"""
WITH a AS (SELECT any_value(total) AS n, sum(n * n / (row * col)) AS s, count(DISTINCT x) AS r, count(DISTINCT y) AS c FROM ({_C})), b AS (SELECT *, n * (s - 1) AS chi2, greatest(0, s - 1 - (r - 1) * (c - 1) / (n - 1)) AS phi2, r - (r - 1) * (r - 1) / (n - 1) AS rr, c - (c - 1) * (c - 1) / (n - 1) AS cc FROM a)
SELECT chi2, CAST(n AS BIGINT) AS n, sqrt(phi2 / (least(rr, cc) - 1)) AS v FROM b
""")
def cramers_v(spark, sf_dir):
    return S.cramers_v(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("WITH g AS (SELECT count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY o_orderpriority), a AS (SELECT sum(n * m) / sum(n) AS m FROM g) SELECT sqrt(sum(n * pow(g.m - a.m, 2)) / (sum(n * pow(g.m - a.m, 2)) + sum(n * v))) AS eta FROM g, a")
def correlation_ratio(spark, sf_dir):
    return S.correlation_ratio(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@query(f"SELECT x, y, n, n * total / (row * col) - 1 AS quetelet, n / total * (n * total / (row * col) - 1) AS contribution, (n - row * col / total) / sqrt(row * col / total) AS residual FROM ({_C})")
def quetelet_table(spark, sf_dir):
    return S.quetelet_table(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN '(all)' ELSE o_orderpriority END AS level, count(*) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std FROM orders GROUP BY ROLLUP (o_orderpriority)")
def tabular_regression(spark, sf_dir):
    return S.tabular_regression(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@query("""
WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS e FROM lineitem), d AS (SELECT len(list_filter(e, lambda v: l_extendedprice > v)) AS x, floor(l_quantity / 10) AS y FROM lineitem, q), c AS (SELECT x, y, count(*) AS n FROM d GROUP BY ALL), m AS (SELECT n, sum(n) OVER (PARTITION BY x) AS r, sum(n) OVER (PARTITION BY y) AS c, sum(n) OVER () AS t FROM c)
SELECT sum(n / t * ln(n * t / (r * c))) AS mi FROM m
""")
def mutual_information(spark, sf_dir):
    return S.mutual_information(S.binned(table(spark, sf_dir, "lineitem"), "l_extendedprice", 4, "x").withColumn("y", F.floor(F.col("l_quantity") / 10)), "x", "y")


def _ranks(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"


@query(f"SELECT corr(a, b) AS rho, count(*) AS n FROM (SELECT {_ranks('l_quantity')} AS a, {_ranks('l_extendedprice')} AS b FROM lineitem)")
def spearman(spark, sf_dir):
    return S.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@query(f"""
WITH r AS (SELECT o_orderpriority AS g, {_ranks('o_totalprice')} AS r FROM orders), t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT count(*) AS c FROM orders GROUP BY o_totalprice)), g AS (SELECT sum(r) AS r, count(*) AS n FROM r GROUP BY g), n AS (SELECT sum(n) AS n FROM g),
h AS (SELECT (12 / (any_value(n.n) * (any_value(n.n) + 1)) * sum(g.r * g.r / g.n) - 3 * (any_value(n.n) + 1)) / (1 - any_value(t) / (pow(any_value(n.n), 3) - any_value(n.n))) AS h FROM g, n, t)
SELECT 'epsilon_sq_rank' AS metric, round((h - 4) / (n - 5), 4) AS value, exp(-h / 2) * (1 + h / 2) AS p_value, 5 AS groups, CAST(n AS BIGINT) AS n FROM h, n
""")
def compare_groups(spark, sf_dir):
    return S.compare_groups(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")


@query("""
WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM g WHERE g = 'F'), b AS (SELECT * FROM g WHERE g = 'O')
SELECT 'cohens_d' AS metric, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 4) AS value, 2 AS groups, a.n + b.n AS n FROM a, b
""")
def compare_two_groups(spark, sf_dir):
    return S.compare_groups(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linestatus").drop("p_value")


@query()
def pairwise_differences(spark, sf_dir):
    return S.pairwise_differences(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


_P = "SELECT p_partkey, (p_partkey * 37 % 1000 + 1) / 20000.0 AS p FROM part"


@query(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS k FROM ({_P})) SELECT p_partkey, p, least(1, max((k - r + 1) * p) OVER (ORDER BY r)) AS adjusted FROM r")
def holm(spark, sf_dir):
    return S.holm(_pvalues(spark, sf_dir))


@query(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS k FROM ({_P})) SELECT p_partkey, p, least(1, min(k * p / r) OVER (ORDER BY r DESC)) AS adjusted FROM r")
def benjamini_hochberg(spark, sf_dir):
    return S.benjamini_hochberg(_pvalues(spark, sf_dir))


def _pvalues(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 37 % 1000 + 1) / 20000.0).alias("p"))


#: p-values of every part, over the whole scale and with ties.
_ALL_P = "SELECT p_partkey, x * x * x * x AS p FROM (SELECT p_partkey, (p_partkey * 37 % 1000 + 1) / 1000.0::DOUBLE AS x FROM part)"


@query(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS k FROM ({_ALL_P})) SELECT p_partkey, p, least(1, max((k - r + 1) * p) OVER (ORDER BY r)) AS adjusted FROM r")
def holm_parts(spark, sf_dir):
    return S.holm(_all_pvalues(spark, sf_dir))


@query(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS k FROM ({_ALL_P})) SELECT p_partkey, p, least(1, min(k * p / r) OVER (ORDER BY r DESC)) AS adjusted FROM r")
def benjamini_hochberg_parts(spark, sf_dir):
    return S.benjamini_hochberg(_all_pvalues(spark, sf_dir))


def _all_pvalues(spark, sf_dir):
    x = (F.col("p_partkey") * 37 % 1000 + 1) / F.lit(1000.0)
    return table(spark, sf_dir, "part").select("p_partkey", (x * x * x * x).alias("p"))


_ICC = """SELECT '{c}' AS "column", count(*) AS k, CAST(sum(n) AS BIGINT) AS n, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS m0, sum(n * pow(m - gm, 2)) / (count(*) - 1) AS msb, sum(n * v) / (sum(n) - count(*)) AS msw
FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM orders_x GROUP BY o_custkey), (SELECT avg({c}) AS gm FROM orders_x)"""


@query("WITH orders_x AS (SELECT *, o_custkey * 10 + o_totalprice / 1000 AS z FROM orders), a AS (" + " UNION ALL ".join(_ICC.format(c=c) for c in ("o_totalprice", "z")) + """), i AS (SELECT *, greatest(0, (msb - msw) / (msb + (m0 - 1) * msw)) AS icc FROM a)
SELECT "column", k, n, m0, icc, 1 + (m0 - 1) * icc AS deff, n / (1 + (m0 - 1) * icc) AS n_eff FROM i""")
def intraclass_correlation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("z", F.col("o_custkey") * 10 + F.col("o_totalprice") / 1000)
    return S.intraclass_correlation(o, "o_custkey", ["o_totalprice", "z"])


@query("WITH w AS (SELECT CASE WHEN c_acctbal > 0 THEN c_acctbal END AS w FROM customer) SELECT count(w) AS n, count(*) - count(w) AS n_dropped, count(w) * sum(w * w) / pow(sum(w), 2) AS deff, pow(sum(w), 2) / sum(w * w) AS n_eff, stddev_pop(w) / avg(w) AS cv, max(w) / min(w) AS range FROM w")
def weight_design_effect(spark, sf_dir):
    return S.weight_design_effect(table(spark, sf_dir, "customer"), "c_acctbal")


@query("WITH m AS (SELECT avg(value) AS m, count(*) AS n, stddev_samp(value) AS s FROM events), g AS (SELECT sum(value - m) AS r FROM events, m GROUP BY user_id) SELECT m AS mean, n, count(*) AS k, s / sqrt(n) AS naive_se, sqrt(sum(r * r) * count(*) / (count(*) - 1)) / n AS cluster_se FROM g, m GROUP BY m, n, s")
def cluster_se(spark, sf_dir):
    return S.cluster_se(table(spark, sf_dir, "events"), "value", "user_id")


@query("WITH s AS (SELECT p_partkey AS id, p_partkey % 500 AS b, p_partkey % 500 + p_size - 1 AS e FROM part), t AS (SELECT id, unnest(range(b, e + 1)) AS t FROM s), c AS (SELECT t, count(*) AS c FROM t GROUP BY 1) SELECT id AS span_id, avg(c) AS mean_concurrency, avg(1.0 / c) AS uniqueness FROM t JOIN c USING (t) GROUP BY 1")
def label_concurrency(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 500).alias("b"), (F.col("p_partkey") % 500 + F.col("p_size") - 1).alias("e"))
    return S.label_concurrency(p, "p_partkey", "b", "e")


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 50 AS d, l_quantity AS v FROM lineitem), w AS (SELECT sum(v) AS tv, count(*) AS tn, var_samp(v) AS var FROM e), n AS (SELECT node, sum(v) AS sv, count(*) AS sn FROM (SELECT unnest(list_distinct([s, d])) AS node, v FROM e) GROUP BY 1), m AS (SELECT (tv - sv) / (tn - sn) AS m FROM n, w WHERE tn > sn)
SELECT any_value(tv / tn) AS mean, any_value(var / tn) AS naive_variance, (count(*) - 1) * var_pop(m) AS jackknife_variance FROM m, w
""")
def dyadic_design_effect(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 50).alias("d"), F.col("l_quantity").alias("v")).distinct()
    return S.dyadic_design_effect(e, "v", "s", "d")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(NUM) for b in NUM[i + 1 :]))
def correlation_matrix(spark, sf_dir):
    return S.correlation_matrix(table(spark, sf_dir, "lineitem"), NUM)


@query("SELECT 'l_quantity' AS \"column\", 1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)) AS vif FROM lineitem UNION ALL SELECT 'l_extendedprice', 1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)) FROM lineitem")
def variance_inflation(spark, sf_dir):
    return S.variance_inflation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])


def _items(spark, sf_dir):
    q, p = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), q.alias("i1"), (q + p).alias("i2"), (q * 0.5 + p).alias("i3"), (p + F.col("l_tax") * 100).alias("i4"))


_I = "SELECT l_quantity AS i1, l_quantity + l_extendedprice / 1000 AS i2, l_quantity * 0.5 + l_extendedprice / 1000 AS i3, l_extendedprice / 1000 + l_tax * 100 AS i4 FROM lineitem"
ITEMS = ["i1", "i2", "i3", "i4"]


@query()
def vif_prune(spark, sf_dir):
    return S.vif_prune(_items(spark, sf_dir), ITEMS)


@query()
def redundancy_blocks(spark, sf_dir):
    return S.redundancy_blocks(_items(spark, sf_dir), ITEMS, 0.9)


@query("SELECT 'l_quantity' AS predictor, regr_slope(l_extendedprice, l_quantity) AS b, corr(l_extendedprice, l_quantity) AS beta, pow(corr(l_extendedprice, l_quantity), 2) AS sr2, corr(l_extendedprice, l_quantity) AS r, pow(corr(l_extendedprice, l_quantity), 2) AS r2_full FROM lineitem")
def semipartial_correlations(spark, sf_dir):
    return S.semipartial(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])


@query("WITH m AS (SELECT avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS s, count(*) AS n FROM customer) SELECT c_custkey, 1.0 / n + pow(c_acctbal - m, 2) / s AS leverage, 1.0 / n + pow(c_acctbal - m, 2) / s > 6.0 / n AS high FROM customer, m")
def leverage(spark, sf_dir):
    return S.leverage(table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal"])


@query("""
WITH f AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a, avg(p_size) AS m, var_pop(p_size) * count(*) AS sx, count(*) AS n FROM part), e AS (SELECT p_partkey, p_retailprice - a - b * p_size AS e, 1.0 / n + pow(p_size - m, 2) / sx AS h, n FROM part, f), s AS (SELECT sum(e * e) AS sse FROM e), t AS (SELECT *, e / sqrt((sse - e * e / (1 - h)) / (n - 3) * (1 - h)) AS t FROM e, s)
SELECT p_partkey, e AS residual, h AS leverage, t AS studentised, e * e * h / (2 * (sse / (n - 2)) * pow(1 - h, 2)) AS cooks_d, t * sqrt(h / (1 - h)) AS dffits FROM t
""")
def influence(spark, sf_dir):
    return S.influence(table(spark, sf_dir, "part"), "p_partkey", "p_retailprice", ["p_size"])


_PAIRS = " + ".join(f"corr({a}, {b})" for i, a in enumerate(ITEMS) for b in ITEMS[i + 1 :])


@query(f"WITH i AS ({_I}), a AS (SELECT count(*) AS n, 4.0 / 3 * (1 - ({' + '.join(f'var_samp({c})' for c in ITEMS)}) / var_samp(i1 + i2 + i3 + i4)) AS alpha, ({_PAIRS}) / 6 AS r FROM i) SELECT n, 4 AS k, alpha, 4 * r / (1 + 3 * r) AS standardised, r AS mean_r FROM a")
def cronbach_alpha(spark, sf_dir):
    return S.cronbach_alpha(_items(spark, sf_dir), ITEMS)


@query(f"WITH i AS ({_I}) " + " UNION ALL ".join(f"SELECT '{c}' AS item, corr({c}, {' + '.join(x for x in ITEMS if x != c)}) AS item_rest_r, 1.5 * (1 - ({' + '.join(f'var_samp({x})' for x in ITEMS if x != c)}) / var_samp({' + '.join(x for x in ITEMS if x != c)})) AS alpha_without FROM i" for c in ITEMS))
def item_statistics(spark, sf_dir):
    return S.item_statistics(_items(spark, sf_dir), ITEMS)


@query()
def factor_loadings(spark, sf_dir):
    return S.factor_loadings(_items(spark, sf_dir), ITEMS)


@query()
def eigenvalue_report(spark, sf_dir):
    return S.eigenvalue_report(_items(spark, sf_dir), ITEMS)


@query()
def parallel_analysis(spark, sf_dir):
    return S.parallel_analysis(_items(spark, sf_dir), ITEMS)


@query()
def ordinal_thresholds(spark, sf_dir):
    return S.ordinal_thresholds(table(spark, sf_dir, "lineitem"), "l_linenumber")


@query()
def polychoric_correlation(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_quantity") / 17).cast("int").alias("x"), F.floor(F.col("l_extendedprice") / 30000).cast("int").alias("y"))
    return spark.createDataFrame([(S.polychoric(d, "x", "y"),)], "rho double")


@query()
def bootstrap_mean(spark, sf_dir):
    return S.bootstrap_ci(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", 200)


@query()
def permutation_test(spark, sf_dir):
    o = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("g"))
    return S.permutation_test(o, "c_custkey", "c_acctbal", "g", 200)


_VERDICT = "CASE WHEN {d} < 1.1 THEN 'negligible' WHEN {d} < 1.5 THEN 'moderate' ELSE 'substantial' END"


@query(f"WITH d AS (SELECT p_partkey, p_size AS h, greatest(1.0, 1 + (greatest(p_size, 1) - 1) * (2 * greatest(p_size, 1) - 1) / (3.0 * greatest(p_size, 1))) AS d FROM part) SELECT p_partkey, 1.0 / greatest(h, 1) AS uniqueness, d AS deff_overlap, 1000 / d AS n_eff, {_VERDICT.format(d='d')} AS verdict FROM d")
def overlapping_label_deff(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("h"), F.lit(1000).alias("n"))
    return S.overlapping_label_deff(p, "h", "n").drop("h", "n")


@query(f"WITH d AS (SELECT p_partkey, greatest(1.0, 1 + (p_size - 1) * CAST(p_size % 11 AS DOUBLE) / 10 * least(1, p_size % 13 / 10.0)) AS d FROM part) SELECT p_partkey, d AS deff_pair, 1000 / d AS n_eff_pair, {_VERDICT.format(d='d')} AS verdict FROM d")
def effective_n_for_association(spark, sf_dir):
    s = F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", (s % 11 / 10).alias("x"), (s % 13 / 10).alias("y"), s.alias("m"), F.lit(1000).alias("n"))
    return S.effective_n_for_association(p, "x", "y", "m", "n").drop("x", "y", "m", "n")


@query(f"WITH w AS (SELECT count(*) * sum(l_quantity * l_quantity) / (sum(l_quantity) * sum(l_quantity)) AS w, count(*) AS n FROM lineitem) SELECT c AS \"column\", 1.0 AS deff_mean, w AS deff_weights, w AS deff_total, n / w AS n_eff_total, {_VERDICT.format(d='w')} AS verdict FROM w, (VALUES ('l_tax'), ('l_extendedprice')) t(c)")
def design_effect_report(spark, sf_dir):
    return S.design_effect_report(table(spark, sf_dir, "lineitem"), ["l_tax", "l_extendedprice"], weight="l_quantity")


@query("SELECT avg(l_extendedprice) AS mean, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS weighted_mean, count(*) AS n FROM lineitem")
def weighted_mean(spark, sf_dir):
    return S.weighted_mean(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity")


@query()
def bootstrap_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return S.bootstrap_diff_ci(o.select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias("g")), "o_orderkey", "o_totalprice", "g", 200)


@query("SELECT 'linear' AS method, quantile_cont(o_totalprice, 0.25) AS q_25, quantile_cont(o_totalprice, 0.5) AS q_50, quantile_cont(o_totalprice, 0.75) AS q_75 FROM orders UNION ALL SELECT 'inverted_cdf', quantile_disc(o_totalprice, 0.25), quantile_disc(o_totalprice, 0.5), quantile_disc(o_totalprice, 0.75) FROM orders")
def quantile_conventions(spark, sf_dir):
    return S.quantile_conventions(table(spark, sf_dir, "orders"), "o_totalprice").where("method IN ('linear', 'inverted_cdf')").drop("n_outliers")


@query()
def quantile_conventions_all(spark, sf_dir):
    return S.quantile_conventions(table(spark, sf_dir, "events"), "value")


@query(f"SELECT 'l_quantity' AS \"column\", true AS kept, NULL AS because_of UNION ALL SELECT 'l_extendedprice', CASE WHEN r >= 0.6 THEN false ELSE true END, CASE WHEN r >= 0.6 THEN 'l_quantity' END FROM (SELECT abs(corr(a, b)) AS r FROM (SELECT {_ranks('l_quantity')} AS a, {_ranks('l_extendedprice')} AS b FROM lineitem)) UNION ALL SELECT 'l_discount', true, NULL")
def prune_redundant(spark, sf_dir):
    return S.prune_redundant(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], threshold=0.6)


@query("SELECT 'exact_identity' AS verdict, count(*) AS n, 'l_quantity,l_tax' AS minimal_subset, 3.0 AS intercept, true AS looks_like_plain_sum FROM lineitem")
def composite_target(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_quantity") + F.col("l_tax") + 3)
    return S.composite_target_probe(d, ["l_quantity", "l_tax", "l_discount"], "y").select("verdict", "n", F.array_join(F.array_sort("minimal_subset"), ",").alias("minimal_subset"), "intercept", "looks_like_plain_sum")


@query(f"SELECT 'spearman' AS measure, round(corr(a, b), 4) AS value FROM (SELECT {_ranks('l_quantity')} AS a, {_ranks('l_extendedprice')} AS b FROM lineitem)")
def association(spark, sf_dir):
    return S.association(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@query()
def polyserial_correlation(spark, sf_dir):
    return S.polyserial(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linenumber")


@query("WITH a AS (SELECT corr(l_quantity, l_extendedprice) AS p, corr(l_quantity, l_tax) AS q, corr(l_extendedprice, l_tax) AS r, var_samp(l_quantity) + var_samp(l_extendedprice) + var_samp(l_tax) AS v, var_samp(l_quantity + l_extendedprice + l_tax) AS t, count(*) AS n FROM lineitem) SELECT n, 1.5 * (1 - v / t) AS alpha, round((p + q + r) / 3, 4) AS mean_inter_item_r, CAST((p < 0)::INTEGER + (q < 0)::INTEGER + (r < 0)::INTEGER AS INTEGER) AS n_negative_pairs, CASE WHEN (p + q + r) / 3 < 0.1 OR 1.5 * (1 - v / t) < 0.3 THEN 'formative_or_broken_reflective_scale_suspected' ELSE 'consistent_with_reflective_indicators' END AS verdict FROM a")
def indicator_direction(spark, sf_dir):
    return S.indicator_direction(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


@query()
def tau_equivalence(spark, sf_dir):
    return S.tau_equivalence(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax", "l_discount"])


@query()
def polychoric_matrix(spark, sf_dir):
    k = F.col("o_orderkey")
    return S.polychoric_matrix(table(spark, sf_dir, "orders").select((k % 3).alias("a"), ((k + k % 3) % 4).alias("b"), F.length("o_orderpriority").alias("c")), ["a", "b", "c"])
