"""Operators whose cost or memory grew faster than their input, or whose digits went with the rows: results over several blocks, and plans that hold no pairs."""

import duckdb
import numpy as np
import pytest
from plumbline import plans, registry  # noqa: F401
from plumbline.operators import models, quality, shapes, statistics, text, vectors
from pyspark.sql import functions as F


def test_distance_correlation_forms_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=500), np.full(300, 0.25), np.round(rng.normal(size=400), 1)])
    y = np.where(rng.random(1200) < 0.2, 1.5, np.round(x**2 + rng.normal(size=1200), 2))
    d = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")
    a, b = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
    a, b = (m - m.mean(axis=0) - m.mean(axis=1)[:, None] + m.mean() for m in (a, b))
    want = np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean()))
    monkeypatch.setattr(vectors, "_blocked", None)
    assert vectors.distance_correlation(d, "id", "x", "y").first().dcor == pytest.approx(want, abs=1e-10)
    # several strips: cuts in the midst of equal values too
    monkeypatch.setattr(vectors, "CUT_ROWS", 100)
    r = vectors.distance_correlation(d, "id", "x", "y").first()
    assert r.n == 1200 and r.dcor == pytest.approx(want, abs=1e-10)
    assert vectors.distance_correlation(d.where("id < 0"), "id", "x", "y").first().dcor == 0
    assert vectors.distance_correlation(d.withColumn("x", F.lit(1.0)), "id", "x", "y").first().dcor == 0


def test_concurrency_lists_no_steps(spark):
    rows = [(1, 0.0, 9.0), (2, 3.0, 3.0), (3, 4.5, 8.2), (4, 8.0, 2.0), (5, 12.0, 10**12 + 12.0), (6, 20.0, 29.0), (7, 1.2, 1.8), (8, None, 3.0), (9, 9.0, 12.0)]
    d = spark.createDataFrame(rows, "id long, b double, e double")
    got = {r.span_id: (r.mean_concurrency, r.uniqueness) for r in statistics.label_concurrency(d, "id", "b", "e").collect()}
    assert sorted(got) == [1, 2, 3, 5, 6, 9]
    # steps 0 to 9: alone but for step 3, for 5 to 8, and for 9
    assert got[1] == pytest.approx((1.6, 0.7)) and got[2] == pytest.approx((2, 0.5)) and got[3] == pytest.approx((2, 0.5))
    assert got[6] == pytest.approx((2, 0.5)) and got[9] == pytest.approx((1.5, 0.75))
    # ten steps of a trillion are shared, and one
    assert got[5] == pytest.approx((1 + 11 / (10**12 + 1), 1 - 5.5 / (10**12 + 1)), rel=1e-15)


def test_identity_is_seen_below_the_digits_of_moments(spark):
    # the first row, by which moments are shifted, is far from the others
    d = spark.range(0, 200_000, 1, 1).select(F.when(F.col("id") == 0, 3e6).otherwise(F.col("id") % 50).alias("a"), (F.col("id") % 7 / 100).alias("b"), (F.xxhash64("id") % 11 / 100).alias("c")).withColumn("y", F.expr("a + b + 3"))
    r = statistics.composite_target_probe(d, ["a", "b", "c"], "y").first()
    assert r.verdict == "exact_identity" and r.relative_residual < 1e-9 and sorted(r.minimal_subset) == ["a", "b"]
    assert r.intercept == pytest.approx(3, abs=2e-6) and r.looks_like_plain_sum


def test_issues_are_parted_as_in_their_sql(spark, tmp_path):
    c = spark.createDataFrame([(k, f"n{k}", "A", float(v)) for k, v in enumerate([5.5, -999.0, -9.0, 12.25, 9999.0, -99.0, 7.5])], "c_custkey long, c_name string, c_mktsegment string, c_acctbal double")
    c.write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    want = sorted(con.execute(registry.ORACLE_SQL["detect_issues"]).fetchall())
    assert ("b", " -9") in want
    assert sorted(tuple(r) for r in registry.QUERIES["detect_issues"](spark, str(tmp_path)).collect()) == want
    # the operator keeps an issue whole
    assert [r.issue for r in quality.detect_issues(c.select("c_acctbal")).collect()] == ["possible_numeric_sentinels:[-999, -99, -9, 9999]"]


def test_vectors_are_shuffled_once_a_block(spark):
    """Blocks grow with the rows, so that a row isn't sent more often where there are more rows, until a block is full."""
    d = spark.range(10).select(F.col("id"), F.array(F.col("id").cast("double")).alias("v"))
    parts = lambda n, width=64: vectors._blocked(d, d, n, width, None, "id long").rdd.getNumPartitions()
    assert parts(2000) == 1 and parts(10_000) == 5
    assert parts(600_000) == parts(100_000) == max(16, 4 * spark.sparkContext.defaultParallelism)
    assert parts(10_000_000) * vectors.BLOCK_BYTES >= 10_000_000 * 64 * 8


def test_recall_of_labels_lists_no_pairs(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "c"), (6, "c"), (7, None), (8, None)], "id long, label string")
    found = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 4), (3, 1), (3, 1), (5, 6), (7, 8)], "id long, neighbour long")
    pairs = d.alias("x").join(d.alias("y"), F.expr("x.label = y.label AND x.id <> y.id")).select(F.col("x.id").alias("id"), F.col("y.id").alias("neighbour"))
    want = {r.id: r.recall for r in vectors.recall_at_k(found, pairs, "id", "neighbour").collect()}
    assert {r.id: r.recall for r in vectors.label_recall(found, d, "id", "label").collect()} == want and set(want) == {1, 2, 3, 5, 6}


def test_models_work_out_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(k, k % 2, float(k % 2 + k % 3), float(k % 5)) for k in range(300)]
    d = spark.createDataFrame(rows, "id long, y int, a double, b double").mapInArrow(counted, "id long, y int, a double, b double")
    assert {r.column for r in models.rfe_select(d, "y", ["a", "b"], 1).collect()} == {"a", "b"} and seen.value == 300
    assert models.single_feature_auc(d, "id", "y", ["a", "b"], folds=2).count() == 2 and seen.value == 600


def test_medians_hold_no_column_in_a_task(spark):
    d = spark.createDataFrame([(k, float(k * k % 101), float(k)) for k in range(101)] + [(200, None, float("nan"))], "id long, x double, y double")
    got = quality.impute(d, ["x", "y"])
    assert tuple(got.first()) == (float(np.median([k * k % 101 for k in range(101)])), 50.0)
    for plan in (got, shapes.fit_rank(d, "x")):
        assert not any(f in plan._jdf.queryExecution().optimizedPlan().toString().lower() for f in ("median", "percentile("))


def test_coverage_of_a_vocabulary_is_one_row_a_text(spark, monkeypatch):
    d = spark.createDataFrame([(1, "one Two two three"), (2, "four five"), (3, None), (4, ""), (None, "one six")], "id long, text string")
    v = spark.createDataFrame([("one",), ("TWO",), (None,)], "token string")
    small = text.vocabulary_coverage(d, v, "id", "text")
    assert "Broadcast" in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(text, "MOST_WORDS", 1)
    for r in (small.first(), text.vocabulary_coverage(d, v, "id", "text").first()):
        assert (r.token_oov, r.n_all_oov, r.type_oov) == pytest.approx((4 / 8, 1, 4 / 6))
