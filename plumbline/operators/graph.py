"""Edges as tables: profile, components, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage, drop_step


def profile(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row: edges, null ends, self-loops, directed and undirected repetitions, nodes, reciprocal share, density, mean and greatest degree."""
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d"))
    whole = e.where("s IS NOT NULL AND d IS NOT NULL")
    d = whole.groupBy("s", "d").agg(F.count("*").alias("n"))
    u = d.select(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    a = u.agg(F.sum("n").alias("n_edges"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("self_loops"), F.sum(F.col("n") - F.col("k")).alias("directed_duplicates"), F.sum(F.col("n") - 1).alias("undirected_duplicates"), F.try_divide(F.sum(F.when(F.col("k") == 2, 2).otherwise(0)), F.sum(F.when(F.col("a") != F.col("b"), F.col("k")).otherwise(0))).alias("reciprocity"), F.count_if(F.col("a") != F.col("b")).alias("_m"))
    deg = u.where("a <> b").select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    loops = u.where("a = b").select(F.col("a").alias("node"), F.lit(0).cast("long").alias("count"))
    n = deg.unionByName(loops).groupBy("node").agg(F.sum("count").alias("k")).agg(F.count("*").alias("n_nodes"), F.avg("k").alias("mean_degree"), F.max("k").alias("max_degree"))
    nulls = e.agg(F.count_if(F.col("s").isNull() | F.col("d").isNull()).alias("null_ends"))
    return a.crossJoin(n).crossJoin(nulls).withColumn("density", F.try_divide(2 * F.col("_m"), F.col("n_nodes") * (F.col("n_nodes") - 1))).drop("_m")


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the least node of each connected component, by alternating stars: a logarithmic number of rounds, each linear in the edges and written to the shared folder."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = cut_lineage(e.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    now = cut_lineage(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, now = now, cut_lineage(small)
        drop_step(before)
        row = tuple(now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000_007)))).first())
        if row == state:
            break
        state = row
    return nodes.join(now.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def triangles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row (triangles, wedges, transitivity). Edges point from the end of smaller degree to the greater, so that no node has many of them, hubs included."""
    u = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where("a IS NOT NULL AND a <> b").distinct()
    deg = u.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count("*").alias("k"))
    e = u.join(deg.select(F.col("x").alias("a"), F.col("k").alias("ka")), "a").join(deg.select(F.col("x").alias("b"), F.col("k").alias("kb")), "b")
    up = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    o = e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("q"))
    two = o.join(o.select("p", F.col("q").alias("r")), "p").where("q < r")
    t = two.join(u, (F.col("q") == F.col("a")) & (F.col("r") == F.col("b"))).agg(F.count("*").alias("triangles"))
    w = deg.agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("long").alias("wedges"))
    return t.crossJoin(w).withColumn("transitivity", F.try_divide(3 * F.col("triangles"), "wedges"))


def split(edges: DataFrame, src: str = "src", dst: str = "dst", mode: str = "inductive", test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """edges with split: inductive puts nodes on a side, and edges across are "dropped"; transductive puts edges on a side."""
    cut = int(test_size * 1_000_000)
    # of the hash's first 32 bits, so that any engine can tell a side
    side = lambda *c: F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(x).cast("string") for x in c], F.lit(str(seed)))), 1, 8), 16, 10).cast("long") % 1_000_000 < cut
    if mode == "transductive":
        return edges.withColumn("split", F.when(side(src, dst), "test").otherwise("train"))
    a, b = side(src), side(dst)
    return edges.withColumn("split", F.when(a & b, "test").when(~a & ~b, "train").otherwise("dropped"))


def cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The edges that lie on or lead between cycles: nodes without an edge in or without one out are peeled away until none is left to peel. Empty if and only if there is no cycle."""
    e = cut_lineage(edges.select(src, dst).dropna().distinct())
    n = e.count()
    while n:
        # merged by hint: edges are small by their files' size, and each round would send the nodes to the driver
        kept = e.join(e.select(F.col(src).alias(dst)).distinct().hint("merge"), dst, "left_semi").join(e.select(F.col(dst).alias(src)).distinct().hint("merge"), src, "left_semi").select(src, dst)
        kept = cut_lineage(kept)
        drop_step(e)
        m, e = kept.count(), kept
        if m == n:
            break
        n = m
    return e
