"""Graphs of customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..registry import query
from ..sources.tables import table

_E = "SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem"
#: Every part and the one that lies p_size further on.
_CHAIN = "SELECT p_partkey AS src, p_partkey + p_size AS dst FROM part"


def edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


def chain(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size")).alias("dst"))


@query(f"""
WITH d AS (SELECT src, dst, count(*) AS n FROM ({_E}) GROUP BY ALL), u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(n) AS BIGINT) AS n, count(*) AS k FROM d GROUP BY 1, 2), deg AS (SELECT node, sum(c) AS k FROM (SELECT unnest([a, b]) AS node, 1 AS c FROM u WHERE a <> b UNION ALL SELECT a, 0 FROM u WHERE a = b) GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_edges, CAST(coalesce(sum(n) FILTER (a = b), 0) AS BIGINT) AS self_loops, CAST(sum(n - k) AS BIGINT) AS directed_duplicates, CAST(sum(n - 1) AS BIGINT) AS undirected_duplicates, coalesce(sum(2) FILTER (k = 2), 0) * 1.0 / sum(k) FILTER (a <> b) AS reciprocity,
 (SELECT count(*) FROM deg) AS n_nodes, (SELECT avg(k) FROM deg) AS mean_degree, (SELECT CAST(max(k) AS BIGINT) FROM deg) AS max_degree, 0::BIGINT AS null_ends, 2.0 * count(*) FILTER (a <> b) / ((SELECT count(*) FROM deg) * ((SELECT count(*) FROM deg) - 1)) AS density FROM u
""")
def graph_profile(spark, sf_dir):
    return G.profile(edges(spark, sf_dir))


@query(f"""
WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM ({_CHAIN}) UNION SELECT dst, src FROM ({_CHAIN})), w(node, component) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM e
  UNION (SELECT u.node, min(v.component) FROM recurring.w u JOIN e ON e.a = u.node JOIN w v ON v.node = e.b WHERE v.component < u.component GROUP BY u.node)
) SELECT node, component FROM w
""")
def connected_components(spark, sf_dir):
    return G.components(chain(spark, sf_dir))


@query(f"""
WITH u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ({_E}) WHERE src <> dst), d AS (SELECT x, count(*) AS k FROM (SELECT unnest([a, b]) AS x FROM u) GROUP BY 1), t AS (SELECT count(*) AS t FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), w AS (SELECT CAST(sum(k * (k - 1) / 2) AS BIGINT) AS w FROM d)
SELECT t AS triangles, w AS wedges, 3.0 * t / w AS transitivity FROM t, w
""")
def triangles(spark, sf_dir):
    return G.triangles(edges(spark, sf_dir))


_SIDE = "('0x' || substr(md5({c} || ':42'), 1, 8))::BIGINT % 1000000 < 200000"


@query(f"SELECT src, dst, CASE WHEN {_SIDE.format(c='src')} AND {_SIDE.format(c='dst')} THEN 'test' WHEN NOT ({_SIDE.format(c='src')}) AND NOT ({_SIDE.format(c='dst')}) THEN 'train' ELSE 'dropped' END AS split FROM ({_E})")
def inductive_split(spark, sf_dir):
    return G.split(edges(spark, sf_dir))


@query(f"SELECT src, dst, CASE WHEN ('0x' || substr(md5(src || ':' || dst || ':42'), 1, 8))::BIGINT % 1000000 < 200000 THEN 'test' ELSE 'train' END AS split FROM ({_E})")
def transductive_split(spark, sf_dir):
    return G.split(edges(spark, sf_dir), mode="transductive")


def looped(spark, sf_dir):
    """Every part and, where p_size is up to 25, the next of its three (a ring), else the one that lies p_size further on: a graph with cycles."""
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(k.alias("src"), F.when(size > 25, k + size).otherwise(k - k % 3 + (k + 1) % 3).cast("long").alias("dst"))


@query()
def cycle_edges(spark, sf_dir):
    return G.cycles(looped(spark, sf_dir))
