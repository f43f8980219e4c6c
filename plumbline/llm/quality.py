"""A quality classifier over document statistics.

Random Fourier features of the standardised statistics approximate a Gaussian kernel; ridge regression on them is fitted from
normal equations that each partition sums for itself; isotonic regression on labelled rows that the fit hasn't seen turns scores
into probabilities. A document is kept if its probability of being good is at least THRESHOLD.

Cost: fitting takes at most MAX_LABELLED labelled rows (those of least hash of doc_id: the same ones on every run), whose texts are
found in one scan by a broadcast join of that bounded sample. Scoring is one pass over the text in numpy, without a shuffle.

Defined cases: a null text is rejected, with null probability; an empty one is scored by its statistics, which are all zero. Labels with a null in either column are passed over;
a document with several labels counts with their mean, rounded up at one half; labels of no document have no effect. Ids can be of any type with an order. Where the labels hold fewer than min_class documents of either class, there is nothing to
learn: every document with a text is kept, with null probability. Repeated rows are scored alike. Further columns pass through quality_filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import U, slices, words
from ._shared import checked_id, drop_written, written

MAX_LABELLED = 20_000
MIN_CLASS = 5
FEATURES = 256
RIDGE = 1e-2
THRESHOLD = 0.5
SEED = 7
CLASSES = ["letters", "capitals", "digits", "blanks", "line feeds", "stops", "commas", "marks", "quotes", "bars", "symbols", "beyond ASCII"]
_KIND = np.full(256, 10, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 0x80:
        _KIND[_b] = 11
    elif _c.islower():
        _KIND[_b] = 0
    elif _c.isupper():
        _KIND[_b] = 1
    elif _c.isdigit():
        _KIND[_b] = 2
    elif _c == "\n":
        _KIND[_b] = 4
    elif _c.isspace():
        _KIND[_b] = 3
    elif _c == ".":
        _KIND[_b] = 5
    elif _c in ",;:":
        _KIND[_b] = 6
    elif _c in "!?":
        _KIND[_b] = 7
    elif _c in "'\"()-":
        _KIND[_b] = 8
    elif _c in "|<>{}[]=":
        _KIND[_b] = 9
WIDTH = len(CLASSES) + 6


def statistics(column: pa.Array) -> np.ndarray:
    """(rows, WIDTH): shares of the byte classes, log bytes, log words, bytes a word, share of distinct words, words a line, share of repeated lines."""
    out = np.zeros((len(column), WIDTH))
    k = len(CLASSES)
    for lo, hi, buf, offs in slices(column):
        n, size = hi - lo, np.diff(offs)
        row = np.repeat(np.arange(n), size)
        counts = np.bincount(row * k + _KIND[buf], minlength=n * k).reshape(n, k) if len(buf) else np.zeros((n, k))
        some = np.maximum(size, 1)
        x = out[lo:hi]
        x[:, :k] = counts / some[:, None]
        h, r = words(buf, offs)
        total = np.bincount(r, minlength=n)
        key = np.sort((r.astype(U) << U(42)) | (h >> U(22)))
        distinct = np.bincount((key[np.append(True, key[1:] != key[:-1])] >> U(42)).astype(np.int64), minlength=n) if len(key) else np.zeros(n)
        lines, repeated = _lines(buf, offs, row, n)
        x[:, k] = np.log1p(size)
        x[:, k + 1] = np.log1p(total)
        x[:, k + 2] = size / np.maximum(total, 1)
        x[:, k + 3] = distinct / np.maximum(total, 1)
        x[:, k + 4] = np.log1p(total / np.maximum(lines, 1))
        x[:, k + 5] = repeated / np.maximum(lines, 1)
    return out


def _lines(buf: np.ndarray, offs: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(lines that aren't empty, those of them that repeat another of the row) by row."""
    if not len(buf):
        return np.zeros(n), np.zeros(n)
    inside = buf != 10
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offs[:-1][offs[:-1] < len(buf)]
    start[first] |= inside[first]
    begin = np.flatnonzero(start)
    if not len(begin):
        return np.zeros(n), np.zeros(n)
    place = np.arange(len(buf), dtype=np.int64)
    place -= np.repeat(place[begin], np.diff(np.append(begin, len(buf)))) if begin[0] == 0 else np.concatenate([np.zeros(begin[0], np.int64), np.repeat(begin, np.diff(np.append(begin, len(buf))))])
    value = np.where(inside, (buf.astype(U) + U(1)) * ((place.astype(U) * U(0x9E3779B97F4A7C15)) | U(1)), U(0))
    h = np.add.reduceat(value, begin)
    r = row[begin]
    key = np.sort((r.astype(U) << U(42)) | (h >> U(22)))
    distinct = np.bincount((key[np.append(True, key[1:] != key[:-1])] >> U(42)).astype(np.int64), minlength=n)
    lines = np.bincount(r, minlength=n)
    return lines, lines - distinct


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        phi = np.sqrt(2 / self.frequency.shape[1]) * np.cos(z @ self.frequency + self.phase)
        return np.concatenate([phi, np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.score(x), self.knots, self.levels)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the non-decreasing function of the score that fits y best (pool adjacent violators); a block's knot is its mean score."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = statistics(b.column(1))
        at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(x.reshape(-1))), b.column(2)], names=["id", "x", "y"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, WIDTH)


def _equations(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = FEATURES + 1
        xx, xy = np.zeros((d, d)), np.zeros(d)
        for b in batches:
            phi = model.features(_matrix(b.column(0)))
            xx += phi.T @ phi
            xy += phi.T @ np.asarray(b.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([xx.tobytes()]), pa.array([xy.tobytes()])], names=["xx", "xy"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, min_class: int = MIN_CLASS, seed: int = SEED) -> Classifier | None:
    """None where there is nothing to learn."""
    kind = checked_id(docs, id_col)
    y = labels.select(F.col(id_col).cast(kind).alias("id"), F.col(label_col).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)")
    y = y.groupBy("id").agg(F.when(F.avg("y") >= 0.5, 1.0).otherwise(0.0).alias("y"))
    y = y.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    # the sample has at most max_labelled rows of 16 bytes
    seen = texts.join(F.broadcast(y), "id").select("id", "text", "y").mapInArrow(_measured, f"id {kind}, x array<double>, y double")
    seen = seen.withColumn("held", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(10)) < 3)
    seen = written(seen.repartition(8, "id").sortWithinPartitions("id"), "labelled")
    n = {r.y: r.n for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if min(n.get(0.0, 0), n.get(1.0, 0)) < min_class:
        drop_written(seen)
        return None
    stats = seen.select(*[F.col("x")[k].alias(f"x{k}") for k in range(WIDTH)])
    row = stats.agg(*[f(f"x{k}") for k in range(WIDTH) for f in (F.avg, F.stddev_pop)]).first()
    rng = np.random.default_rng(seed)
    model = Classifier(np.array(row[0::2]), np.maximum(np.array(row[1::2]), 1e-6), rng.normal(size=(WIDTH, FEATURES)) / np.sqrt(WIDTH / 2), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    sums = seen.where("NOT held").select("x", "y").mapInArrow(_equations(model), "xx binary, xy binary").collect()
    d = FEATURES + 1
    xx = sum(np.frombuffer(r.xx).reshape(d, d) for r in sums)
    xy = sum(np.frombuffer(r.xy) for r in sums)
    model.weights = np.linalg.solve(xx + RIDGE * np.eye(d), xy)
    held = seen.where("held").select("id", "x", "y").orderBy("id").toArrow()  # at most max_labelled rows
    if held.num_rows:
        model.knots, model.levels = isotonic(model.score(_matrix(held.column("x").combine_chunks())), held.column("y").to_numpy())
    else:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    drop_written(seen)
    return model


def _scorer(model: Classifier, text_at: int, keep: list[int], names: list[str], only: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(text_at)
            p = model.probability(statistics(column))
            null = np.asarray(column.is_null())
            if only is None:
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(p, mask=null)], names=names)
            else:
                chosen = pa.array(np.flatnonzero((p >= only) & ~null))
                yield b.take(chosen)

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """(doc_id, probability, keep) of every row of docs."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **fitting)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return slim.select("doc_id", F.lit(None).cast("double").alias("probability"), F.col("text").isNotNull().alias("keep"))
    out = slim.mapInArrow(_scorer(model, 1, [0], ["doc_id", "probability"], None), f"doc_id {slim.schema[0].dataType.simpleString()}, probability double")
    return out.withColumn("keep", F.coalesce(F.col("probability") >= threshold, F.lit(False)))


def quality_filter(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """docs without those that the classifier rejects."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **fitting)
    if model is None:
        return docs.where(F.col(text_col).isNotNull())
    return docs.mapInArrow(_scorer(model, docs.columns.index(text_col), [], [], threshold), docs.schema)
