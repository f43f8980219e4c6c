"""Queries that have to cover a table wholly, and not a part of it."""

from plumbline import plans, registry  # noqa: F401

SF = "/root/testdata/sf0.01"


def test_every_part_is_adjusted(spark):
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    for name in ("holm_parts", "benjamini_hochberg_parts", "holm", "benjamini_hochberg"):
        r = registry.QUERIES[name](spark, SF).collect()
        assert len({x.p_partkey for x in r}) == len(r) == n > 200
        assert name in ("holm", "benjamini_hochberg") or (any(x.adjusted < 0.05 for x in r) and any(x.adjusted > 0.5 for x in r))
        assert all(x.adjusted >= x.p for x in r)


def test_every_event_type_is_put_on_the_grid(spark):
    want = {r.event_type for r in spark.read.parquet(f"{SF}/events.parquet").select("event_type").distinct().collect()}
    assert len(want) == 5
    for name in ("regular_grid_all", "regular_grid"):
        assert {r.event_type for r in registry.QUERIES[name](spark, SF).select("event_type").distinct().collect()} == want


def test_edges_on_cycles_one_by_one(spark):
    from plumbline.plans import graph

    edges = {(r.src, r.dst) for r in graph.looped(spark, SF).collect()}
    while True:
        out, in_ = {a for a, _ in edges}, {b for _, b in edges}
        kept = {(a, b) for a, b in edges if a in in_ and b in out}
        if kept == edges:
            break
        edges = kept
    got = {(r.src, r.dst) for r in registry.QUERIES["cycle_edges"](spark, SF).collect()}
    assert got == edges and len(got) > 10
