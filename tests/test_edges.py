"""Nulls, empty tables, ties and known values, operator by operator."""

import datetime as dt

import pytest
from plumbline.functions import columns as C
from plumbline.functions import distributions as D
from plumbline.operators import decisions, features, graph, quality, relational, series, statistics, text, vectors
from plumbline.sources import tables
from pyspark.sql import functions as F


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_as_of_takes_null_keys_and_early_facts(spark):
    facts = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, None, 5), (4, "b", 5), (5, "a", None), (6, "a", 3)], "id int, k string, t int")
    versions = spark.createDataFrame([("a", 3, "x"), ("a", 4, "y"), (None, 1, "z"), ("a", 4, "w")], "k string, t int, v string")
    assert rows(relational.as_of(facts, versions, "k", "t", "t", ["v"]).select("id", "v"), "id") == [(1, "y"), (2, None), (3, None), (4, None), (5, None), (6, "x")]
    assert relational.as_of(facts.limit(0), versions, "k", "t", "t", ["v"]).count() == 0


def test_valid_at_keeps_all_facts(spark):
    facts = spark.createDataFrame([(1, "c", 5), (2, "c", 10), (3, None, 5), (4, "c", 99)], "id int, k string, t int")
    versions = spark.createDataFrame([("c", 0, 10, "old"), ("c", 10, None, "new")], "k string, b int, e int, v string")
    assert rows(relational.valid_at(facts, versions, "k", "t", "b", "e", ["v"]).select("id", "v"), "id") == [(1, "old"), (2, "new"), (3, None), (4, "new")]


def test_overlaps_count_each_pair_once(spark):
    s = spark.createDataFrame([(1, "k", 0, 100), (2, "k", 50, 60), (3, "k", 60, 70), (4, "k", 5, 5), (5, "z", 0, 100), (6, None, 0, 9), (7, None, 0, 9)], "id int, k string, b long, e long")
    for width in (1, 7, 1000):
        assert rows(relational.overlaps(s, ["k"], "id", "b", "e", width).select("a", "b"), "a", "b") == [(1, 2), (1, 3)]


def test_concurrency_ends_before_it_begins(spark):
    s = spark.createDataFrame([("k", 0, 5), ("k", 5, 9), ("k", 4, 6), ("k", 2, 2)], "k string, b int, e int")
    assert rows(relational.max_concurrency(s, ["k"], "b", "e"), "k") == [("k", 2)]


def test_upsert_refuses_older_rows(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", None)], "k int, v string, seq int")
    new = spark.createDataFrame([(1, "late", 4), (2, "n", 6), (2, "m", 7), (4, "new", None), (3, "d", 1)], "k int, v string, seq int")
    assert rows(tables.upserted(old, new, ["k"], "seq").select("k", "v"), "k") == [(1, "a"), (2, "m"), (3, "d"), (4, "new")]


def test_basic_statistics_known_values(spark):
    d = spark.createDataFrame([(float(x),) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "x double")
    assert tuple(round(v, 3) for v in relational.stats(d, "x").first()) == (5, 2.138, 2, 9, 8)
    assert tuple(relational.stats(d.limit(0), "x").first()) == (0, 0, 0, 0, 0)
    assert relational.stats(d.limit(1), "x").first()["std"] == 0


def test_broken_rules_are_reported(spark):
    d = spark.createDataFrame([(9, 8, 30), (1, 2, 170), (None, 2, 5)], "start int, finish int, age int")
    got = {r.rule: r for r in relational.rules_report(d, {"order": "start < finish", "age": "age <= 120", "none": "nope > 1"}).collect()}
    assert (got["order"].violations, got["order"].unevaluable, got["age"].violations) == (1, 1, 1) and got["none"].error


def test_rolling_and_lag(spark):
    d = spark.createDataFrame([(k, float(k)) for k in range(1, 11)], "t int, v double")
    out = series.add_lags(series.add_rolling(d, "v", [3], ["t"], ["mean"]), "v", [1], ["t"])
    assert [r[2] for r in rows(out, "t")][:5] == [None, None, None, 2.0, 3.0] and rows(out, "t")[5][3] == 5.0


def test_grid_carries_the_last_value(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    d = spark.createDataFrame([(t(0), 10.0), (t(1), 11.0), (t(3), 13.0), (t(3), 14.0), (None, 5.0)], "t timestamp, v double")
    assert [r.v for r in series.to_regular_grid(d, "t", "1 HOUR", ["v"]).orderBy("t").collect()] == [10, 11, 11, 13]


def test_partial_autocorrelation_of_a_chain(spark):
    import numpy as np

    x, out, rng = 0.0, [], np.random.default_rng(0)
    for k in range(400):
        x = 0.8 * x + float(rng.normal())
        out.append((k, x))
    p = series.pacf(spark.createDataFrame(out, "t int, v double"), "v", ["t"], 3)
    assert p[0] == 1 and 0.6 < p[1] < 0.95 and abs(p[2]) < 0.3


def test_weights_of_fractional_difference():
    assert [round(w, 4) for w in series.frac_diff_weights(0.5, 0.05)] == [1, -0.5, -0.125, -0.0625]


def test_quality_of_hostile_columns(spark):
    d = spark.createDataFrame([(float("inf"), "a@b.c", "N/A", 1), (float("nan"), "a@b.c", "cafÃ©", 1), (1.0, "a@b.c", None, 1)] * 4, "ratio double, email string, note string, const int")
    p = {r.column: r for r in quality.profile_schema(d).collect()}
    assert (p["ratio"].n_inf, p["ratio"].n_missing) == (4, 4) and p["note"].n_missing == 4
    issues = {(r.column, r.issue) for r in quality.detect_issues(d).collect()}
    assert {("ratio", "non_finite_values:4"), ("note", "string_sentinels"), ("note", "encoding_artifacts"), ("const", "constant_value"), ("email", "constant_value"), ("const", "integer_may_be_category_code")} <= issues
    assert {r.role for r in quality.profile_schema(d.limit(0)).collect()} == {"empty"}


def test_label_variants_and_conflicts(spark):
    d = spark.createDataFrame([("Apples",)] * 10 + [("apples ",)] * 4 + [("appels",)] * 3 + [("XL",)] * 5 + [("XXL",)] * 4 + [(None,)], "c string")
    got = {(r.a, r.b, r.reason) for r in quality.label_variants(d, "c", 0.6).collect()}
    assert ("Apples", "apples ", "normalized") in got and not any("XL" in x for x in got)
    k = spark.createDataFrame([(1, "monitor"), (1, "monitor stand"), (2, "apple"), (None, "x"), (None, "y")], "pid int, name string")
    assert rows(quality.key_conflicts(k, ["pid"], ["name"]).select("pid", "n_distinct"), "pid") == [(None, 2), (1, 2)]


def test_funnel_names_small_groups(spark):
    d = spark.createDataFrame([("low", 1 if k < 135 else 0) for k in range(450)] + [("high", 1 if k < 315 else 0) for k in range(450)] + [("tiny", 1)] * 10 + [(None, 1)], "g string, y int")
    got = {r.g: r for r in quality.rate_funnel(d, "y", "g").collect()}
    assert got["low"].outside_funnel and got["high"].outside_funnel and got["tiny"].small_group and got["tiny"].outside_funnel and got["tiny"].positives == 10


def test_dispersion_verdicts(spark):
    f = lambda xs: quality.count_dispersion(spark.createDataFrame([(float(x),) for x in xs], "x double"), "x").first().verdict
    assert f([1.5, 2.5] * 20) == "not_count_data" and f([0] * 20) == "not_count_data" and f([1.5, 2.5, 1.5]) == "insufficient_data" and f([1, 2, 3]) == "insufficient_data" and f([0, 20] * 20) == "overdispersed" and f([3, 3, 3, 4] * 10) == "underdispersed"


def test_a_group_that_beats_its_training_is_an_anomaly(spark):
    d = spark.createDataFrame([(1, 0.5, 0.9), (2, 0.9, 0.8), (3, 0.9, 0.5), (4, 0.0, 0.5)], "id int, train double, test double")
    assert {r.id: r.verdict for r in decisions.generalisation_gap(d, "train", "test").collect()} == {1: "anomaly", 2: "fine", 3: "severe", 4: None}


def test_flags_look_at_both_sides(spark):
    side = lambda rows: spark.createDataFrame(rows, "node string, n int, rate double, cost double")
    got = {r.node: r.flags for r in relational.flags(side([("a", 5, 0.0, 1.0), ("b", 5, 0.0, 1.0), ("c", 5, 1.0, 2.0), ("d", 5, 1.0, 1.0), ("e", 0, None, None)]), side([("a", 5, 1.0, 1.0), ("b", 5, 0.0, 1.0), ("c", 5, 1.0, 1.0), ("d", 5, 0.5, 1.0), ("e", 5, 0.5, 1.0)]), "node").collect()}
    assert got == {"a": "", "b": "always_failing", "c": "non_discriminating,cost_regression", "d": "flaky", "e": "missing_data,flaky"}


def test_the_ratio_needs_a_positive_bottom(spark):
    f = lambda xs: quality.decile_ratio(spark.createDataFrame([(float(x),) for x in xs], "x double"), "x").first().ratio
    assert f([-5, *range(1, 20)]) is None and f(range(1, 21)) == pytest.approx(19.5 / 1.5)


def test_shift_is_judged_against_its_floor(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "v double")
    a, b, c = rng.normal(size=100), rng.normal(size=100), rng.normal(2, 1, 400)
    small = quality.population_shift(frame(a), frame(b), "v").first()
    assert small.verdict == "stable" and small.psi_null_expected == pytest.approx(9 * 0.02) and not small.psi_reliable and small.n_bins == 10
    edges = np.unique(np.percentile(a, np.linspace(0, 100, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    p, q = (np.maximum(np.histogram(x, edges)[0] / len(x), 0.5 / len(x)) for x in (a, c))
    big = quality.population_shift(frame(a), frame(c), "v").first()
    assert big.verdict == "major_shift" and big.psi == pytest.approx(((p - q) * np.log(p / q)).sum(), abs=1e-5)
    grid = np.sort(np.concatenate([a, c]))
    gap = np.abs(np.searchsorted(np.sort(a), grid, side="right") / 100 - np.searchsorted(np.sort(c), grid, side="right") / 400)
    assert big.ks_stat == pytest.approx(gap.max(), abs=1e-6) and big.wasserstein == pytest.approx((gap[:-1] * np.diff(grid)).sum(), abs=1e-5)
    words = lambda x: spark.createDataFrame([(v,) for v in x], "v string")
    cat = quality.population_shift(words(["x"] * 50 + ["y"] * 50), words(["x"] * 10 + ["z"] * 90), "v").first()
    assert cat.kind == "categorical" and cat.unseen == ["z"] and cat.verdict == "major_shift"
    assert quality.population_shift(frame([1.0]), frame(b), "v").first().verdict == "insufficient_data"
    assert quality.population_shift(frame([1.0] * 50), frame(b), "v", categorical=False).first().verdict == "degenerate_reference"


def test_roles_of_texts(spark):
    rows_ = [(f"user number {k} of many", f"2024-01-{k % 28 + 1:02d}", "a, b; c", ["red", "green", "blue"][k % 3], k, k % 5, k / 7, k % 2 == 0) for k in range(60)]
    d = spark.createDataFrame(rows_, "t string, d string, l string, n string, i int, c int, x double, b boolean")
    got = {r.column: r.role for r in quality.profile_schema(d, target="n").collect()}
    assert got == {"t": "free_text", "d": "datetime_text", "l": "binary", "n": "target/nominal", "i": "identifier", "c": "count", "x": "continuous", "b": "binary"}
    assert {r.column: r.role for r in quality.profile_schema(d, ["x"], id_columns=["x"]).collect()} == {"x": "identifier"}
    assert {r.column: r.role for r in quality.profile_schema(d.withColumn("l", F.concat("l", F.lit(","), "t")), ["l"]).collect()} == {"l": "multi_label_or_list"}


def test_ordered_sums_and_quantiles(spark):
    import numpy as np
    from plumbline.functions import ordering

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1e6, 200), rng.normal(0, 1e-6, 200), rng.integers(-5, 5, 300).astype(float), [0.0, -0.0, 1e300, -1e300, 5e-324, 2.0**40, 2.0**40 - 1]])
    d = spark.createDataFrame([(float(v), int(k % 3)) for k, v in enumerate(x)], "v double, g int")
    got = sorted(ordering.ordered_sums(ordering.levels(d, F.col("v")), following=True).collect(), key=lambda r: r.x)
    values, counts = np.unique(x, return_counts=True)
    assert [r.x for r in got] == values.tolist() and [r.n_before for r in got] == (np.cumsum(counts) - counts).tolist() and {r.n_all for r in got} == {len(x)}
    assert [r.next_x for r in got] == [*values[1:].tolist(), None]
    for r in ordering.quantiles(d, F.col("v"), [0.1, 0.5, 0.99], ["a", "b", "c"], ["g"]).collect():
        assert np.allclose([r.a, r.b, r.c], np.quantile(x[np.arange(len(x)) % 3 == r.g], [0.1, 0.5, 0.99]))
    assert ordering.quantiles(d.limit(0), F.col("v"), [0.5], ["m"]).collect() == [(None,)]


def test_blocked_neighbours(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 5))
    x[7] = x[8] = x[9]
    x[20] = 0
    for ids, kind in (([k for k in range(90)], "long"), ([f"r{k:03d}" for k in range(90)], "string")):
        d = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(None, [0.0] * 5), (ids[0], None)], f"id {kind}, v array<double>")
        for metric in ("cosine", "euclidean"):
            u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x
            s = u @ u.T if metric == "cosine" else -np.linalg.norm(u[:, None] - u[None], axis=2)
            got = {(r.id, r["rank"]): (r.neighbour, r.score) for r in vectors.neighbours(d, d, "id", "v", 4, metric).collect()}
            assert len(got) == 360
            for i in range(90):
                want = sorted((j for j in range(90) if j != i), key=lambda j: (-round(s[i, j], 9), j))[:4]
                assert [got[ids[i], k + 1][0] for k in range(4)] == [ids[j] for j in want], (metric, i)
                assert np.allclose([got[ids[i], k + 1][1] for k in range(4)], s[i, want], atol=1e-7)


def test_weights_that_do_not_count(spark):
    r = statistics.weight_design_effect(spark.createDataFrame([(1.0,), (-2.0,), (None,), (3.0,)], "w double"), "w").first()
    assert (r.n, r.n_dropped) == (2, 2)
    assert statistics.weight_design_effect(spark.createDataFrame([(2.0,)] * 5, "w double"), "w").first().deff == 1


def test_association_extremes(spark):
    d = spark.createDataFrame([(k % 2, k % 2, 1, float(k)) for k in range(40)] + [(None, 1, 1, None)], "x int, y int, c int, v double")
    assert statistics.cramers_v(d, "x", "y").first().v == pytest.approx(1, abs=0.02)
    assert statistics.cramers_v(d, "x", "c").first().v == 0
    assert statistics.spearman(d, "v", "v").first().rho == pytest.approx(1)
    assert statistics.cramers_v(d.limit(0), "x", "y").first().v in (0, None)


def test_matrix_diagnostics_by_hand(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    x[:, 2] = x[:, 0] + x[:, 1] + 0.1 * rng.normal(size=300)
    d = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "id int, a double, b double, c double")
    n, mean, cov = statistics.moments(d, ["a", "b", "c"])
    assert n == 300 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T))
    v = {r.column: r.vif for r in statistics.variance_inflation(d, ["a", "b", "c"]).collect()}
    assert np.allclose([v[c] for c in "abc"], np.diag(np.linalg.inv(np.corrcoef(x.T))), rtol=1e-6)
    h = x - x.mean(axis=0)
    want = 1 / 300 + np.einsum("ij,jk,ik->i", h, np.linalg.inv(h.T @ h), h)
    assert np.allclose([r.leverage for r in statistics.leverage(d, "id", ["a", "b", "c"]).orderBy("id").collect()], want)
    assert statistics.vif_prune(d, ["a", "b", "c"]).count() == 1


def test_polychoric_recovers_the_correlation(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    z = rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], 4000)
    d = spark.createDataFrame([(int(a), int(b)) for a, b in zip(np.digitize(z[:, 0], [-0.5, 0.7]), np.digitize(z[:, 1], [-1, 0, 1]), strict=True)], "x int, y int")
    assert statistics.polychoric(d, "x", "y") == pytest.approx(0.6, abs=0.05)


def test_tails():
    assert D.chi2_tail(3.841, 1) == pytest.approx(0.05, abs=1e-4) and D.t_tail(2.2281, 10) == pytest.approx(0.05, abs=1e-4) and D.f_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)


def test_thresholds_of_a_known_curve(spark):
    d = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.5), (0, 0.5), (None, 0.4), (1, None)], "y int, s double")
    sw = decisions.sweep(d, "y", "s")
    assert decisions.auc(d, "y", "s").first().auc == pytest.approx(8 / 9)
    assert decisions.pick(sw, "youden").first().threshold == 0.6
    assert decisions.pick(sw, "min-precision", min_precision=1.0).first().threshold == 0.8


def test_agreement(spark):
    d = spark.createDataFrame([(1, 1), (0, 0), (1, 0), (None, 1)], "a int, b int")
    assert decisions.kappa(d, "a", "b").first().kappa == pytest.approx(0.4)


def test_written_lists(spark):
    d = spark.createDataFrame([("(a, b)",), ("[B;c|D]",), ("",), (None,), (" x ",)], "t string")
    assert [r[0] for r in d.select(C.multi_value("t")).collect()] == [["a", "b"], ["b", "c", "d"], [], [], ["x"]]


def test_resampling_reaches_the_ratio(spark):
    d = spark.createDataFrame([(k, int(k < 5)) for k in range(100)], "id int, y int")
    over = features.resample(d, "id", "y", 0.5, "over").groupBy("y").count().collect()
    under = features.resample(d, "id", "y", 0.5).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in over} == {0: 95, 1: 48} and {r.y: r["count"] for r in under} == {0: 10, 1: 5}


def test_chunks_of_a_word_list(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h"), (2, " "), (3, None), (4, "one")], "id int, t string")
    assert rows(text.chunks(d, "id", "t", 4, 1), "id", "chunk_index") == [(1, 0, "a b c d"), (1, 1, "d e f g"), (1, 2, "g h"), (4, 0, "one")]


def test_search_needs_every_word(spark):
    d = spark.createDataFrame([(1, "grouping sets"), (2, "group sort"), (3, "groping sets"), (4, None)], "id int, t string")
    assert {r.id for r in text.search(d, "id", ["t"], "grouping set").collect()} == {1, 3}
    assert text.search(d, "id", ["t"], "").count() == 4


def test_ranking_ties_and_zero_vectors(spark):
    d = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, [-1.0, 0.0])], "id int, v array<double>")
    assert [(r.id, r.score) for r in vectors.rank(d, [1.0, 0.0], "id", "v", 4).collect()] == [(1, 1.0), (3, 1.0), (2, 0.0), (4, -1.0)]


def test_graph_of_known_shape(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 0), (5, 5), (None, 3)], "src long, dst long")
    p = graph.profile(e).first()
    assert (p.n_edges, p.self_loops, p.undirected_duplicates, p.n_nodes, p.null_ends) == (5, 1, 1, 4, 1)
    assert {r.node: r.component for r in graph.components(e).collect()} == {0: 0, 1: 0, 2: 0, 5: 5}
    assert graph.triangles(e).first().triangles == 1
    assert graph.cycles(e).count() == 4 and graph.cycles(e.where("src = 0")).count() == 0
    assert graph.components(e.limit(0)).count() == 0


def test_torn_lines_and_front_matter(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b"\n\n{"a": 3}\n')
    assert rows(tables.read_jsonl(spark, str(tmp_path / "x.json"), "a int, b string"), "a") == [(1, "x"), (3, None)]
    (tmp_path / "t.csv").write_text("a,b\n1,NA\n2,x\n")
    assert rows(tables.read_csv(spark, str(tmp_path / "t.csv")), "a") == [(1, None), (2, "x")]
    d = spark.createDataFrame([("---\nname: one\ndescription: \"two: three\"\n---\nbody",), ("no head",)], "t string")
    assert [r[0] for r in d.select(tables.front_matter(F.col("t"))).collect()] == [{"name": "one", "description": "two: three"}, {}]


def test_fixed_text_rounds_as_printf(spark):
    xs = [k / 20 for k in range(-40, 400)] + [k / 2 for k in range(-9, 9)] + [0.15, 0.35, 1.005, 358.65, 405.95, 999.95, 1e15, 123456789.25, 1e-9, 5e-324]
    d = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    got = d.select("x", C.fixed_text("x", 0), C.fixed_text("x", 1), C.fixed_text("x", 2)).collect()
    want = [(x, *(f"{x:.{k}f}" for k in range(3))) for x in xs] + [(None,) * 4]
    assert [(tuple(r), w) for r, w in zip(got, want, strict=True) if tuple(r) != w] == []


def test_readable_numbers_at_ties(spark, tmp_path):
    """Prices halfway between two texts, by decimal digits or exactly in binary; no price, keys below 0 and beyond 2^53."""
    import duckdb
    from plumbline import plans, registry  # noqa: F401

    prices = [50.0 * k for k in range(1, 400, 2)] + [358650.0, 405950.0, 1250000.0, 1350000.0, 999950.0, 999.5, 998.5, 0.5, 1.5, 0.0, -2.5, -0.3, 1e15]
    spark.createDataFrame([(k, float(p)) for k, p in enumerate(prices)] + [(-61, 7.0), (2**62, 8.0), (10**6, None)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.execute(registry.ORACLE_SQL["readable_numbers"]).fetchall()
    assert rows(registry.QUERIES["readable_numbers"](spark, str(tmp_path)).select("o_orderkey", "price", "duration"), "o_orderkey") == sorted(want)
