"""Quality classifier by held-out accuracy, mixing by brute force and exact sums."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from plumbline.llm import mixing, quality


def make(rng, good):
    w = ["".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(2, 9)))) for _ in range(int(rng.integers(20, 120)))]
    if good:
        return " ".join(w).capitalize() + "."
    return " ".join(x.upper() + rng.choice(["!!!", "$$$", "|||", "###"]) for x in w)


def labelled(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(k, make(rng, k % 2 == 0), k % 2 == 0) for k in range(n)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(g), 0) for k, _, g in rows], "doc_id long, quality int, toxic int")
    return docs, labels, {k: g for k, _, g in rows}


def test_classifier_on_documents_it_has_not_seen(spark):
    docs, labels, truth = labelled(spark)
    got = {r.doc_id: r.keep for r in quality.quality_scores(docs, labels.where("doc_id < 200")).collect()}
    assert np.mean([got[k] == truth[k] for k in range(200, 400)]) > 0.97


def test_normal_equations_match_one_solve(spark):
    docs, labels, _ = labelled(spark, 120)
    model = quality.fit(docs, labels)
    again = quality.fit(docs.repartition(7), labels.repartition(3))
    assert np.allclose(model.weights, again.weights) and np.allclose(model.levels, again.levels)
    assert (np.diff(model.levels) >= 0).all() and (np.diff(model.knots) >= 0).all()


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    d, n = quality.WIDTH, 40_000
    freq = rng.normal(size=(d, n)) / np.sqrt(d / 2)
    m = quality.Classifier(np.zeros(d), np.ones(d), freq, rng.uniform(0, 2 * np.pi, n), np.zeros(n + 1), np.zeros(1), np.zeros(1))
    x = rng.normal(size=(6, d))
    phi = m.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / d)
    assert np.abs(phi @ phi.T - want).max() < 0.03


def test_isotonic_is_the_best_monotone_fit():
    knots, levels = quality.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert np.allclose(levels, [0, 0.5, 1]) and np.allclose(knots, [1, 2.5, 4.5])


def test_statistics_by_hand():
    x = quality.statistics(pa.array(["Ab 1\nab\nab", None, ""]))
    assert np.isclose(x[0, quality.CLASSES.index("capitals")], 1 / 10) and np.isclose(x[0, quality.CLASSES.index("line feeds")], 2 / 10)
    assert np.isclose(x[0, -1], 1 / 3) and not x[1:].any()


def test_classifier_cases(spark):
    docs, labels, _ = labelled(spark)
    more = spark.createDataFrame([(None, "Some words in a row."), (900, None), (901, ""), (902, "x y " * 100_000), (0, "Twice the same id.")], docs.schema)
    noise = spark.createDataFrame([(None, 1, 0), (5, None, 0), (99_999, 1, 1), (0, 1, 0), (0, 1, 0)], labels.schema)
    both = docs.union(more).selectExpr("*", "1 AS probability", "2 AS keep", "3 AS x")
    out = quality.quality_scores(both, labels.union(noise))
    assert out.count() == 405
    assert out.where("doc_id = 900").first().keep is False and out.where("doc_id = 900").first().probability is None
    kept = quality.quality_filter(both, labels.union(noise))
    assert kept.columns == both.columns and kept.where("text IS NULL").count() == 0
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    nothing = quality.quality_scores(both, labels.limit(0))
    assert nothing.where("keep").count() == 404 and nothing.where("probability IS NOT NULL").count() == 0
    assert quality.quality_filter(both, labels.where("quality = 1")).count() == 404


def brute_mix(rows, weights, default, budget, seed):
    """Draws in order, one by one."""
    out, toks = [], lambda t: len(re.findall(r"[^ \t\n\r\f]+", t))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    live = [(i, t, s) for i, t, s in rows if t is not None and toks(t)]
    sources = {s for *_, s in live}
    total = {s: sum(toks(t) for _, t, x in live if x == s) for s in sources}
    whole, w = budget if budget is not None else sum(total.values()), {s: weights.get(s, default) for s in sources}
    for s in sources:
        left, epoch = int(whole * w[s] / sum(w.values()) if w[s] else 0), 0
        mine = sorted((md5(f"{seed}:{i if i is not None else md5(t)}"), md5(t), i, t) for i, t, x in live if x == s) if all(i is not None for i, *_ in live) else sorted(((md5(f"{seed}:{i if i is not None else md5(t)}"), md5(t), i, t) for i, t, x in live if x == s), key=lambda v: v[:2])
        while left > 0:
            epoch += 1
            for _, _, i, t in mine:
                if left <= 0:
                    break
                take = min(left, toks(t))
                out.append((i, s, epoch, toks(t), take))
                left -= take
    return out


def test_mixing_against_one_by_one(spark):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 40))), f"s{int(rng.integers(0, 4))}") for k in range(300)] + [(1000, None, "s0"), (None, "a b c", "s1"), (7, "x y", "s2"), (7, "x y", "s2"), (2000, "q " * 50_000, "s3"), (2001, "lone text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bucket", __import__("pyspark").sql.functions.lit(1))
    for weights, budget in (({"s0": 6.0}, None), ({"s0": 0.0, "s1": 3.5}, 9_999), ({}, 100), ({"s2": 50.0}, 70_000)):
        got = mixing.mix_plan(docs, weights=weights, budget=budget).collect()
        want = brute_mix(rows, weights, 1.0, budget, mixing.SEED)
        assert sorted(((r.doc_id, r.source, r.epoch, r.n_tokens, r.take_tokens) for r in got), key=str) == sorted(want, key=str)
        drawn = mixing.mix_documents(docs, weights=weights, budget=budget)
        assert drawn.columns == docs.columns
        n = {r.source: 0 for r in got}
        for r in got:
            n[r.source] += r.take_tokens
        have = {}
        for r in drawn.collect():
            have[r.source] = have.get(r.source, 0) + len(re.findall(r"[^ \t\n\r\f]+", r.text))
        assert have == {s: k for s, k in n.items() if k}


def test_mixing_empty_and_wrong(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(docs).count() == 0 and mixing.mix_documents(docs).count() == 0
    import pytest

    with pytest.raises(ValueError):
        mixing.mix_plan(docs, weights={"a": -1.0})


def test_weights_against_a_dense_solve_and_ids_of_any_type(spark):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    texts = [" ".join(["word"] * int(rng.integers(5, 40))) + "." if k % 3 else "$$ ## " * int(rng.integers(3, 30)) for k in range(200)]
    label = [int(k % 3 > 0) for k in range(200)]
    docs = spark.createDataFrame([(f"d{k}", t, "x") for k, t in enumerate(texts)], "doc_id string, text string, y string").repartition(3)
    labels = spark.createDataFrame([(f"d{k}", v) for k, v in enumerate(label)] + [("none", 1)], "doc_id string, quality int")
    model = quality.fit(docs, labels)
    held = {r.id for r in spark.createDataFrame([(f"d{k}",) for k in range(200)], "id string").where("pmod(xxhash64(id, 8), 10) < 3").collect()}
    x, y = quality.statistics(pa.array(texts)), np.array(label, float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    phi = np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((x - mean) / scale, -8, 8) @ model.frequency + model.phase)
    phi = np.concatenate([phi, np.ones((200, 1))], axis=1)
    fit = np.array([f"d{k}" not in held for k in range(200)])
    # ridge as least squares over rows that are stacked on the penalty
    stacked = np.concatenate([phi[fit], np.sqrt(quality.RIDGE) * np.eye(phi.shape[1])])
    want = np.linalg.lstsq(stacked, np.concatenate([y[fit], np.zeros(phi.shape[1])]), rcond=None)[0]
    assert np.allclose(phi @ want, model.score(x), atol=1e-6)
    scored = {r.doc_id: r.keep for r in quality.quality_scores(docs, labels).collect()}
    assert sum(scored[f"d{k}"] == bool(label[k]) for k in range(200)) > 195
    assert quality.quality_scores(docs, labels, min_class=1000).where("probability IS NULL AND keep").count() == 200
