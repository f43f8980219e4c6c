"""Records made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifests as M
from ..registry import query
from ..sources.tables import table


@query("SELECT 'n_missing in ' || c AS issue, 'medium' AS severity, CAST(n AS VARCHAR) || ' rows' AS evidence, 'open' AS status, 'fact' AS claim_kind FROM (SELECT 'l_tax' AS c, count(*) FILTER (l_tax = 0) AS n FROM lineitem UNION ALL SELECT 'l_discount', count(*) FILTER (l_discount = 0) FROM lineitem)")
def findings(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").agg(*[F.count_if(F.col(c) == 0).alias(c) for c in ("l_tax", "l_discount")]).select(F.explode(F.create_map(F.lit("l_tax"), "l_tax", F.lit("l_discount"), "l_discount")).alias("c", "n"))
    return M.from_table(n, "finding", issue=F.concat(F.lit("n_missing in "), "c"), evidence=F.concat(F.col("n").cast("string"), F.lit(" rows"))).select("issue", "severity", "evidence", "status", "claim_kind")


@query("SELECT 'stratified_random' AS strategy, o_orderstatus AS group_key, 42::BIGINT AS seed, count(*) AS n FROM orders GROUP BY 2")
def split_manifests(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return M.from_table(n, "split_manifest", group_key=F.col("o_orderstatus"), seed=F.lit(42), row_counts=F.create_map(F.lit("all"), "n")).select("strategy", "group_key", "seed", F.col("row_counts")["all"].alias("n"))
