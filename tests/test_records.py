"""Records with nulls, repetitions and torn runs."""

from plumbline.operators import records as R
from pyspark.sql import functions as F


def test_flips_take_the_last_result(spark):
    h = spark.createDataFrame([(1, "a", "pass", 1), (1, "b", "fail", 2), (2, "a", "pass", 3), (2, "a", "fail", 4), (2, "b", "pass", 5), (2, "c", "pass", 6), (0, "z", "pass", 0)], "run int, node string, r string, seq int")
    assert {r.node: r.flip for r in R.flips(h, "run", "node", "r", "seq").collect()} == {"a": "broken", "b": "fixed", "c": "new"}
    assert R.flips(h.limit(0), "run", "node", "r", "seq").count() == 0


def test_outcomes(spark):
    d = spark.createDataFrame([(0.5, 1.0, 0.5, None), (1.0, 0.4, 0.5, None), (None, 0.6, 0.5, "e"), (None, None, None, None), (None, None, 0.5, "e")], "g double, s double, t double, e string")
    assert [r[0] for r in d.select(R.outcome(F.col("g"), F.col("s"), F.col("t"), F.col("e"))).collect()] == [False, False, True, True, False]


def test_titles_and_negations(spark):
    t = spark.createDataFrame([(1, 0, "user", " first\n text "), (1, 1, "title", "Old"), (1, 2, "title", "New"), (2, 0, "assistant", "x"), (2, 1, "user", "y" * 99), (3, 0, None, None)], "c int, turn int, role string, text string")
    assert {r.c: r.title for r in R.titles(t, "c", "turn", "role", "text").collect()} == {1: "New", 2: "y" * 70, 3: None}
    d = spark.createDataFrame([(1, "It is broken. It is not broken."), (2, None), (3, "fine")], "i int, t string")
    assert {r.i: (r.hits, r.negated) for r in R.marker_hits(d, "i", "t", "broken").collect()} == {1: (2, 1), 3: (0, 0)}


def test_practices(spark):
    d = spark.createDataFrame([("n", [("p", True), ("q", False)]), ("n", [("p", False)]), ("m", None)], "node string, ps array<struct<practice:string,passed:boolean>>")
    assert {(r.node, r.practice): (r.n, r.pass_rate) for r in R.practice_rates(d, "node", "ps").collect()} == {("n", "p"): (2, 0.5), ("n", "q"): (1, 0.0)}
