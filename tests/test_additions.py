"""Operators without SQL, or whose SQL is narrower than they are, against numpy on small tables."""

import math

import numpy as np
import pytest
from plumbline.operators import features, manifests, models, quality, series, statistics, vectors
from plumbline.sources import tables
from plumbline.streaming import events
from pyspark.sql import functions as F


def frame(spark, x, names):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names))


def test_quantile_conventions(spark):
    rng = np.random.default_rng(1)
    for n in (4, 11, 40):
        x = np.round(rng.normal(size=n), 1)
        got = {r.method: r for r in statistics.quantile_conventions(frame(spark, x[:, None], ["v"]), "v").collect()}
        for m in ("linear", "hazen", "weibull", "median_unbiased", "normal_unbiased", "inverted_cdf", "averaged_inverted_cdf", "closest_observation", "interpolated_inverted_cdf"):
            want = np.quantile(x, [0.25, 0.5, 0.75], method=m)
            assert np.allclose([got[m].q_25, got[m].q_50, got[m].q_75], want), (n, m)
            lo, hi = want[0] - 1.5 * (want[2] - want[0]), want[2] + 1.5 * (want[2] - want[0])
            assert got[m].n_outliers == int(((x < lo - 1e-12) | (x > hi + 1e-12)).sum())
    assert statistics.quantile_conventions(frame(spark, [[1.0]] * 3, ["v"]), "v").count() == 0


def test_numeric_summary_and_outliers(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=200), [9, -9, np.nan]])
    y = np.round(rng.exponential(size=203), 1)
    d = frame(spark, np.stack([x, y], axis=1), ["x", "y"])
    r = {q.column: q for q in quality.numeric_summary(d, ["x", "y"]).collect()}
    v = x[~np.isnan(x)]
    assert np.allclose([r["x"].q01, r["x"].median, r["x"].q99, r["x"].iqr, r["x"].mad], [*np.quantile(v, [0.01, 0.5, 0.99]), np.subtract(*np.quantile(v, [0.75, 0.25])), np.median(np.abs(v - np.median(v)))])
    assert (r["x"].n, r["x"].n_unique, r["y"].n_unique) == (202, 202, len(np.unique(y)))
    q = {s.column: s for s in quality.univariate_report(d, ["x", "y"]).collect()}
    a, z = np.quantile(v, [0.25, 0.75])
    assert q["x"].n_iqr == int(((v < a - 1.5 * (z - a)) | (v > z + 1.5 * (z - a))).sum())
    assert quality.robust_z_flags(d, "x").where("is_outlier").count() == q["x"].n_robust_z


def test_composite_targets(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    d = frame(spark, x, ["a", "b", "c"])
    r = statistics.composite_target_probe(d.withColumn("y", F.expr("a + b + 2")), ["a", "b", "c"], "y").first()
    assert r.verdict == "exact_identity" and sorted(r.minimal_subset) == ["a", "b"] and r.looks_like_plain_sum and r.intercept == 2
    near = statistics.composite_target_probe(d.withColumn("y", F.expr("a - 2 * b + 0.01 * c * c")), ["a", "b"], "y").first()
    assert near.verdict == "near_identity" and np.allclose(near.weights, [1, -2], atol=0.01)
    assert statistics.composite_target_probe(d.withColumn("y", F.expr("a * b")), ["a", "b"], "y").first().verdict == "no_identity"
    assert statistics.composite_target_probe(d.withColumn("y", F.lit(1.0)), ["a"], "y").first().verdict == "degenerate_target"
    assert statistics.composite_target_probe(d.limit(3).withColumn("y", F.col("a")), ["a"], "y").first().verdict == "insufficient_rows"


def test_redundant_columns(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=300)
    d = frame(spark, np.stack([a, np.exp(a) + 0.01 * rng.normal(size=300), rng.normal(size=300)], axis=1), ["a", "b", "c"])
    assert {r.column: (r.kept, r.because_of) for r in statistics.prune_redundant(d, ["a", "b", "c"]).collect()} == {"a": (True, None), "b": (False, "a"), "c": (True, None)}
    assert {r.column: r.kept for r in statistics.prune_redundant(d, ["a", "b", "c"], [0.1, 0.9, 0.5]).collect()} == {"a": False, "b": True, "c": True}


def test_bootstrap_difference(spark):
    rng = np.random.default_rng(5)
    d = spark.createDataFrame([(k, float(v + (k % 2)), k % 2 == 1) for k, v in enumerate(rng.normal(size=400))], "id long, v double, g boolean")
    r = statistics.bootstrap_diff_ci(d, "id", "v", "g", 300).first()
    x = np.array([q.v for q in d.orderBy("id").collect()])
    assert r.estimate == pytest.approx(x[1::2].mean() - x[::2].mean(), abs=1e-5) and (r.n_a, r.n_b) == (200, 200)
    half = 1.96 * math.sqrt(x[1::2].var(ddof=1) / 200 + x[::2].var(ddof=1) / 200)
    assert r.excludes_zero and r.low == pytest.approx(r.estimate - half, abs=0.06) and r.high == pytest.approx(r.estimate + half, abs=0.06)


def test_design_effects_of_clusters_and_weights(spark):
    d = spark.createDataFrame([(k // 5, float(k // 5), 1.0 + k % 2) for k in range(100)], "g int, v double, w double")
    r = statistics.design_effect_report(d, ["v"], "g", "w").first()
    w = np.array([1.0 + k % 2 for k in range(100)])
    kish = 100 * (w**2).sum() / w.sum() ** 2
    assert r.deff_mean == pytest.approx(5) and r.deff_total == pytest.approx(5 * kish) and r.n_eff_total == pytest.approx(100 / 5 / kish) and r.verdict == "substantial"


def test_silhouettes_and_distances(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(40, 3)), rng.normal(3, 1, size=(30, 3)), [[50, 50, 50], [0, 0, 0]]])
    label = [0] * 40 + [1] * 30 + [2, -1]
    d = spark.createDataFrame([(k, v.tolist(), c) for k, (v, c) in enumerate(zip(x, label, strict=True))], "id long, v array<double>, c int")
    keep = np.array(label) >= 0
    y, lab = x[keep], np.array(label)[keep]
    dist = np.linalg.norm(y[:, None] - y[None], axis=2)
    want = []
    for i in range(len(y)):
        own = lab == lab[i]
        a = dist[i, own].sum() / max(1, own.sum() - 1)
        b = min(dist[i, lab == c].mean() for c in set(lab) - {lab[i]})
        want.append(0.0 if own.sum() == 1 else (b - a) / max(a, b))
    got = {r.id: r.silhouette for r in vectors.silhouettes(d, "id", "v", "c").collect()}
    assert np.allclose([got[k] for k in np.flatnonzero(keep)], want, atol=1e-6) and len(got) == len(y)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    kth = np.sort(np.linalg.norm(z[:, None] - z[None], axis=2), axis=1)[:, 5]
    s = vectors.nn_distance_summary(d, "id", "v").first()
    assert s.mean_kth_nn == pytest.approx(kth.mean(), abs=1e-4) and s.cv_kth_nn == pytest.approx(kth.std() / kth.mean(), abs=1e-4)
    e = np.sort(kth)
    knee = np.argmax(np.abs((e - e.min()) / (e.max() - e.min() + 1e-12) - np.linspace(0, 1, len(e))))
    assert vectors.k_distance(d, "id", "v").first().eps_candidate == pytest.approx(e[knee], abs=1e-4)


def test_ordinal_correlations(spark):
    rng = np.random.default_rng(7)
    z = rng.multivariate_normal([0, 0], [[1, 0.5], [0.5, 1]], 3000)
    d = spark.createDataFrame([(float(a), int(np.digitize(b, [-0.6, 0.2, 1.1])), int(np.digitize(a, [-0.3, 0.8]))) for a, b in z], "x double, y int, u int")
    r = statistics.polyserial(d, "x", "y").first()
    assert r.rho == pytest.approx(0.5, abs=0.05) and abs(r.pearson_r) < abs(r.rho) and r.n_categories == 4 and r.verdict == "measured"
    assert statistics.polyserial(d.limit(5), "x", "y").first().verdict == "insufficient_rows"
    m = statistics.polychoric_matrix(d, ["y", "u"]).first()
    assert m.polychoric == pytest.approx(0.5, abs=0.06) and m.smoothed == pytest.approx(m.polychoric, abs=1e-6) and m.pearson < m.polychoric
    assert statistics.positive_definite(np.array([[1, 0.9], [0.9, 1]]))[2] and not statistics.positive_definite(np.array([[1, 2.0], [2.0, 1]]))[2]


def test_scales(spark):
    rng = np.random.default_rng(8)
    f = rng.normal(size=800)
    d = frame(spark, np.stack([f + rng.normal(size=800) for _ in range(4)], axis=1), list("abcd"))
    r = statistics.tau_equivalence(d, list("abcd")).first()
    assert r.verdict == "tau_equivalent_alpha_is_appropriate" and r.omega == pytest.approx(r.alpha, abs=0.01)
    bad = frame(spark, np.stack([f * w + rng.normal(size=800) for w in (0.2, 1, 3)], axis=1), list("abc"))
    assert statistics.tau_equivalence(bad, list("abc")).first().verdict == "congeneric_prefer_omega"
    assert statistics.indicator_direction(d, list("abcd")).first().verdict == "consistent_with_reflective_indicators"
    assert statistics.indicator_direction(frame(spark, rng.normal(size=(200, 3)), list("abc")), list("abc")).first().verdict.startswith("formative")
    load = rng.normal(size=(6, 2))
    assert np.allclose((statistics.rotate_loadings(load, "varimax")[0] ** 2).sum(axis=1), (load**2).sum(axis=1))


def test_clusters_one_by_one(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 0.2, (60, 2)), rng.normal(4, 0.2, (50, 2)), rng.normal([0, 5], 0.2, (40, 2))])
    d = frame(spark, x, ["a", "b"])
    groups, centres, _ = models.anomalous_clusters(d, "id", ["a", "b"], 5)
    s = (x - x.mean(axis=0)) / np.ptp(x, axis=0)
    left, want = np.arange(len(s)), []
    while len(left):
        ref = (s[left] ** 2).sum(axis=1)
        c, members = s[left[ref.argmax()]], None
        while True:
            new = left[((s[left] - c) ** 2).sum(axis=1) < ref]
            new = new if len(new) else left[[ref.argmax()]]
            if members is not None and np.array_equal(new, members):
                break
            members, c = new, s[new].mean(axis=0)
        want.append(len(members))
        left = np.setdiff1d(left, members)
    assert [r.size for r in groups.orderBy("order").collect()] == want
    k = {r.id: r.cluster for r in models.ik_means(d, "id", ["a", "b"], 5).collect()}
    assert len({k[0], k[70], k[120]}) == 3 and all(len({k[i] for i in r}) == 1 for r in (range(60), range(60, 110), range(110, 150)))


def test_importances_find_the_column_that_matters(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 3))
    d = spark.createDataFrame([(k, *map(float, v), int(v[1] + 0.2 * rng.normal() > 0)) for k, v in enumerate(x)], "id long, a double, b double, c double, y int")
    p = {r.column: r.importance for r in models.permutation_importance_oof(d, "id", "y", ["a", "b", "c"], 2, 4).collect()}
    assert p["b"] > 0.2 and abs(p["a"]) < 0.1 and abs(p["c"]) < 0.1
    n = {r.column: r.above_noise for r in models.null_target_importance(d, "id", "y", ["a", "b", "c"], 3, 4, 10).collect()}
    assert n["b"]
    assert {r.column: r.selected for r in models.rfe_select(d, "y", ["a", "b", "c"], 1).collect()} == {"a": False, "b": True, "c": False}
    dealt = models._shuffled(d, "id", "a", 4, 1)
    assert sorted(r.a for r in dealt.collect()) == sorted(r.a for r in d.collect()) and dealt.join(d.select("id", F.col("a").alias("o")), "id").where("a = o").count() < 60


def test_records(spark, tmp_path):
    f = manifests.records(spark, "finding", [{"issue": "x", "evidence": "3 rows"}])
    assert (f.first().severity, f.first().status, f.first().issue) == ("medium", "open", "x")
    with pytest.raises(ValueError):
        manifests.records(spark, "finding", [{"colour": "red"}])
    m = manifests.records(spark, "feature_manifest", [{"features": [tuple("f" if k == "name" else None for k in manifests.KINDS["feature_spec"])]}])
    manifests.save(str(tmp_path), finding=f, feature_manifest=m)
    manifests.save(str(tmp_path), finding=f)
    assert manifests.load(spark, str(tmp_path), "finding").collect() == f.collect()
    assert manifests.load(spark, str(tmp_path), "feature_manifest").first().features[0].name == "f"
    assert '"severity":"medium"' in manifests.to_json(f).first().json and '"likely_cause":null' in manifests.to_json(f).first().json
    assert all(manifests.records(spark, k, [{}]).count() == 1 for k in manifests.KINDS)


def test_files_and_states(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a"\n')
    assert {(r.a, r.raw) for r in tables.read_jsonl(spark, str(tmp_path / "a.json"), "a int", rescued="raw").collect()} == {(1, None), (None, '{"a"')}
    (tmp_path / "b.json").write_text("{}")
    assert {r.path.rsplit("/", 1)[1] for r in tables.listing(spark, str(tmp_path)).collect()} == {"a.json", "b.json"}
    # two batches: the second carries on the state of the first, and so does a restart
    src, at = tmp_path / "in", tmp_path / "at"
    put = lambda k: spark.createDataFrame([(1, 1.0), (2 + k, 5.0)], "k long, v double").coalesce(1).write.mode("append").parquet(str(src))
    put(0)

    def run():
        seen = []
        s = events.running_totals(events.read_files(spark, str(src), "k long, v double"), "k", "v")
        s.writeStream.foreachBatch(lambda b, _: seen.extend(tuple(r) for r in b.collect())).outputMode("update").option("checkpointLocation", str(at)).trigger(availableNow=True).start().awaitTermination()
        return sorted(seen)

    assert run() == [(1, 1, 1.0), (2, 1, 5.0)]
    put(1)
    assert run() == [(1, 2, 2.0), (3, 1, 5.0)]
    assert run() == []


def test_series_and_flags(spark):
    d = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("a", 3, 0.0), ("a", 4, 1.0), ("b", 1, None)], "g string, t int, v double")
    got = {(r.g, r.t): r.v_pct1 for r in series.percent_change(d, "v", 1, ["t"], ["g"]).collect()}
    assert got == {("a", 1): None, ("a", 2): 0.5, ("a", 3): -1.0, ("a", 4): None, ("b", 1): None}
    assert [r.v_reversed for r in series.reversed_column(d, "v", ["t"], ["g"]).orderBy("g", "t").collect()] == [1.0, 0.0, 3.0, 2.0, None]
    assert [r.v_isna for r in features.missing_indicator(d, ["v"]).orderBy("g", "t").collect()] == [0, 0, 0, 0, 1]
    assert series.purge_and_embargo(d.where("g = 'a'"), "t", 3, 3, 1).count() == 2 and series.purge_and_embargo(d.where("g = 'a'"), "t", 3, 3, 1, 0).count() == 3


def test_tendency_and_dependence(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(12)
    even, tight = rng.uniform(size=(300, 2)), np.concatenate([rng.normal(c, 0.02, (100, 2)) for c in (0, 1, 3)])
    h = [vectors.hopkins(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>"), "id", "v", 0.3).first().hopkins for x in (even, tight)]
    assert 0.35 < h[0] < 0.65 and h[1] > 0.85
    x = rng.normal(size=150)
    y = x * x + 0.1 * rng.normal(size=150)
    a, b = (np.abs(v[:, None] - v[None]) for v in (x, y))
    centre = lambda m: m - m.mean(axis=0) - m.mean(axis=1)[:, None] + m.mean()
    a, b = centre(a), centre(b)
    want = math.sqrt((a * b).mean() / math.sqrt((a * a).mean() * (b * b).mean()))
    assert vectors.distance_correlation(frame(spark, np.stack([x, y], axis=1), ["x", "y"]), "id", "x", "y").first().dcor == pytest.approx(want, abs=1e-9)


def test_low_rank_imputation(spark):
    rng = np.random.default_rng(13)
    f = rng.normal(size=200)
    x = np.stack([f, 2 * f + 1, -f], axis=1) + 0.05 * rng.normal(size=(200, 3))
    gone = rng.random((200, 3)) < 0.15
    d = spark.createDataFrame([(k, *[None if g else float(v) for v, g in zip(r, m, strict=True)]) for k, (r, m) in enumerate(zip(x, gone, strict=True))], "id long, a double, b double, c double").repartition(3)
    y = np.where(gone, np.nan, x)
    mu, sd = np.nanmean(y, axis=0), np.nanstd(y, axis=0)
    z, last, want = np.where(gone, 0, (y - mu) / sd), np.inf, []
    for _ in range(100):
        u, s, vt = np.linalg.svd(z, full_matrices=False)
        low = u[:, :1] * s[:1] @ vt[:1]
        z = np.where(gone, low, z)
        want.append(round(float(((z - low)[~gone] ** 2).sum()), 6))
        if last - want[-1] < 1e-6 * max(last, 1e-12):
            break
        last = want[-1]
    out, objective = quality.lowrank_impute(d, ["a", "b", "c"])
    got = np.array([[r.a, r.b, r.c] for r in out.orderBy("id").collect()])
    assert np.allclose(objective, want, atol=1e-5) and np.allclose(got, z * sd + mu, atol=1e-6) and np.median(np.abs(got[gone] - x[gone])) < 0.5
    assert statistics.expected_max_noise_correlation(100, 50)[0] == pytest.approx(0.25, abs=0.05)
