"""Document fingerprints: a quartile bucket digest, and for each document the nearest other digest.

Every five bytes in a row give three byte triplets, each hashed to one of 128 buckets. A bucket's code (2 bits) tells in which
quarter of the 128 counts its own lies; the digest is these codes, the code of the length (steps of 10 %), and two ratios of the
quartiles. Texts that share most of their bytes get digests that differ in few codes, whatever the order of their parts.

The difference of two digests adds, for each bucket, 0, 1, 2 or 6 for codes 0 to 3 apart, and the distances of the ratios (around
the circle of 16) and of the length codes; length codes more than 1 apart count 12 for each step. It is bounded: beyond BOUND the
score isn't followed further (null). BOUND is set from measured distances (see README): most copies with 3 to 5 % of their words replaced lie within it, of
short texts fewer. Of texts above some 3000 characters unrelated ones of a language can lie within it, too, as their counts approach the language's own;
where that matters, take a smaller difference from the result.

nearest_digests finds every pair within BOUND exactly: length codes that are further apart than the bound allows can't be within it; all other pairs are compared, tile by tile, by one bit
of each code (a lower bound of the difference), and what that leaves by the whole difference. Equal digests collapse before, so thousands of copies
cost one comparison. For each document only its best partner leaves a task.

Every document gets its digest and is searched in; which ones search is a parameter (asks). The query op10 asks for ids divisible by EVERY, since all pairs of a large table take too long.

Cost: the text is read once, in numpy. Documents meet by range of lengths, so a digest is shuffled once or twice, and once more for every CELL documents of its range that ask. Comparisons, of a few nanoseconds each,
number documents that ask times documents of like length; bands of equal codes would spare few of them, as at this bound a band has but four buckets.

Defined cases: ids can be of any type with an order. A null text and one of fewer than MIN_BYTES bytes have no digest, and no partner. Ties go to the smaller doc_id.
Rows that share a doc_id count as one document (the least of their digests). Rows of null doc_id get a digest but neither have nor are partners. Columns other than the two named don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._kernels import U, mix, slices
from ._shared import checked_id, written

BUCKETS = 128
MIN_BYTES = 50
BOUND = 30
CELL = 20_000
#: Rows of a part that are searched in, for one that asks.
SIDE = 8
#: The query op10 asks for ids divisible by this.
EVERY = 20
#: Length codes that share a range; rows within reach of another range are searched in there, too.
RANGE = 8
#: Rows and columns of a tile of comparisons, which stays in a core's cache.
TILE = 16, 2048
PLANES = ["h0", "h1", "l0", "l1"]
_T = (mix(np.arange(3 * 3 * 256, dtype=U)) >> U(40)).astype(np.uint32).reshape(3, 3, 256)
TRIPLETS = [(0, 1, 2), (0, 1, 3), (0, 2, 4)]


def digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes (rows, 128) of 0 to 3, header (rows, 3): length code and the two quartile ratios)."""
    n = len(column)
    codes, head = np.zeros((n, BUCKETS), np.uint8), np.zeros((n, 3), np.uint8)
    for lo, hi, buf, offs in slices(column):
        size = np.diff(offs)
        rows = hi - lo
        counts = np.zeros(rows * BUCKETS, np.int64)
        if len(buf) >= 5:
            row = np.repeat(np.arange(rows, dtype=np.int64), size)
            whole = np.flatnonzero(row[:-4] == row[4:])
            base = row[whole] * BUCKETS
            part = [buf[k : len(buf) - 4 + k][whole] for k in range(5)]
            for t, (a, b, c) in enumerate(TRIPLETS):
                h = _T[t, 0][part[a]] + _T[t, 1][part[b]] + _T[t, 2][part[c]]
                bucket = (h * np.uint32(0x9E3779B1)) >> np.uint32(25)
                counts += np.bincount(base + bucket, minlength=len(counts))
        counts = counts.reshape(rows, BUCKETS)
        order = np.sort(counts, axis=1)
        q = order[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        codes[lo:hi] = (counts[:, :, None] > q[:, None, :]).sum(axis=2)
        top = np.maximum(q[:, 2], 1)
        head[lo:hi, 0] = np.minimum(np.round(np.log(np.maximum(size, 1)) / np.log(1.1)), 255)
        head[lo:hi, 1] = q[:, 0] * 100 // top % 16
        head[lo:hi, 2] = q[:, 1] * 100 // top % 16
    return codes, head


def packed(codes: np.ndarray) -> np.ndarray:
    """(rows, 4) words: the codes' high bits, then their low bits."""
    return np.concatenate([np.packbits(codes >> 1, axis=1, bitorder="little").view(U), np.packbits(codes & 1, axis=1, bitorder="little").view(U)], axis=1)


def difference(a: np.ndarray, b: np.ndarray, ha: np.ndarray, hb: np.ndarray) -> np.ndarray:
    """Of packed digests and headers, row by row; not bounded."""
    total = np.zeros(len(a), np.int64)
    for w in range(2):
        h, k, hx, kx = a[:, w], a[:, w + 2], b[:, w], b[:, w + 2]
        x1, x2, x3 = (h | k) ^ (hx | kx), h ^ hx, (h & k) ^ (hx & kx)
        total += sum(np.bitwise_count(x).astype(np.int64) for x in (x1, x2, x3)) + 3 * np.bitwise_count(x1 & x2 & x3).astype(np.int64)
    d = np.abs(ha.astype(np.int64) - hb)
    total += np.where(d[:, 0] <= 1, d[:, 0], 12 * d[:, 0])
    return total + np.minimum(d[:, 1:], 16 - d[:, 1:]).sum(axis=1)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes, head = digests(b.column(1))
        p = packed(codes).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(4)), *(pa.array(head[:, k].astype(np.int32)) for k in range(3))], names=["id", *PLANES, "len", "r1", "r2"])


def _hex():
    return F.lower(F.concat(F.lpad(F.hex("len"), 2, "0"), F.hex("r1"), F.hex("r2"), *(F.lpad(F.hex(c), 16, "0") for c in PLANES)))


def _reach(bound: int) -> int:
    """How far apart length codes within the bound can be."""
    return max(1, bound // 12)


def _best(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < 50_000:
                continue
            t = pa.Table.from_batches(held)
            key, cell = t.column("key").to_numpy(), t.column("cell").to_numpy()
            whole = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            held = t.slice(cut).to_batches()
            yield from _best_of(t.slice(0, cut), bound)
        if held:
            yield from _best_of(pa.Table.from_batches(held), bound)

    return run


def _best_of(t: pa.Table, bound: int) -> Iterator[pa.RecordBatch]:
    """The best partner within the bound of each row that asks, among the other rows of its cell."""
    n = t.num_rows
    if not n:
        return
    key, cell, asking = (t.column(c).to_numpy() for c in ("key", "cell", "asking"))
    # numbers in the order of the ids, whatever their type
    kind = t.schema.field("id").type
    names, ids = np.unique(t.column("id").to_numpy(), return_inverse=True)
    sig = np.stack([t.column(c).to_numpy() for c in PLANES], axis=1).view(U)
    head = np.stack([t.column(c).to_numpy() for c in ("len", "r1", "r2")], axis=1)
    high = np.ascontiguousarray(sig[:, :2].T)
    begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
    best, other = np.full(n, bound + 1), np.full(n, np.iinfo(np.int64).max)
    reach = _reach(bound)

    def offer(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> None:
        """d of each row x to the row y: kept if better, or as good and y of smaller id."""
        o = np.lexsort((ids[y], d, x))
        x, y, d = x[o], y[o], d[o]
        first = np.append(True, x[1:] != x[:-1])
        x, y, d = x[first], ids[y[first]], d[first]
        better = (d < best[x]) | ((d == best[x]) & (y < other[x]))
        best[x[better]], other[x[better]] = d[better], y[better]

    def compare(a: np.ndarray, b: np.ndarray, apart: int) -> None:
        """Rows a, which ask, against all rows b, whose length codes are so far apart."""
        cost = apart if apart <= 1 else 12 * apart
        for u in range(0, len(b), TILE[1]):
            y = b[u : u + TILE[1]]
            there = high[:, y]
            for s in range(0, len(a), TILE[0]):
                x = a[s : s + TILE[0]]
                low = np.bitwise_count(high[0, x][:, None] ^ there[0])
                if bound - cost > 12:  # the first 64 buckets alone tell little then
                    low += np.bitwise_count(high[1, x][:, None] ^ there[1])
                # what is worse than the best so far needs no whole difference
                left = np.maximum(np.minimum(best[x], bound) - cost, 0).astype(np.uint8)
                i, j = np.divmod(np.flatnonzero(low <= left[:, None]), len(y))
                if not len(i):
                    continue
                i, j = x[i], y[j]
                d = difference(sig[i], sig[j], head[i], head[j])
                hit = (d <= bound) & (ids[i] != ids[j])
                if hit.any():
                    offer(i[hit], j[hit], d[hit])

    for lo, hi in zip(begin, np.append(begin[1:], n), strict=True):
        one, two = ({int(c): rows[head[rows, 0] == c] for c in np.unique(head[rows, 0])} for rows in (lo + np.flatnonzero(asking[lo:hi]), lo + np.flatnonzero(~asking[lo:hi])))
        for c, rows in one.items():
            for d in range(c - reach, c + reach + 1):
                if d in two:
                    compare(rows, two[d], abs(c - d))
    hit = best <= bound
    yield pa.RecordBatch.from_arrays([pa.array(names[ids[hit]], kind), pa.array(names[other[hit]], kind), pa.array(best[hit].astype(np.int32))], names=["id", "other", "d"])


def _met(asked: DataFrame, all_: DataFrame, cell: int, bound: int) -> DataFrame:
    """Rows of both tables with key, cell and asking: each row that asks is in one cell with every row of all_ whose length is within reach, once.

    Of a range of lengths, the rows that ask are cut into parts of about `cell`, all rows into parts of SIDE times as many, and each part of the one meets each of the other."""
    width, reach = max(RANGE, _reach(bound)), _reach(bound)
    asked = asked.withColumn("key", F.floor(F.col("len") / width))
    all_ = all_.withColumn("key", F.explode(F.sequence(F.floor((F.col("len") - reach) / width), F.floor((F.col("len") + reach) / width))))
    n = asked.groupBy("key").agg(F.ceil(F.count("*") / cell).alias("qs")).join(all_.groupBy("key").agg(F.ceil(F.count("*") / (cell * SIDE)).alias("ts")), "key")
    # a row for each range of length codes, of which there are 256
    n = F.broadcast(n)
    asked = asked.join(n, "key").withColumn("cell", F.explode(F.expr("transform(sequence(0L, ts - 1), t -> pmod(xxhash64(id), qs) * 4294967296L + t)"))).withColumn("asking", F.lit(True))
    all_ = all_.join(n, "key").withColumn("cell", F.explode(F.expr("transform(sequence(0L, qs - 1), q -> q * 4294967296L + pmod(xxhash64(id), ts))"))).withColumn("asking", F.lit(False))
    return asked.unionByName(all_).drop("qs", "ts").repartition("key", "cell").sortWithinPartitions("key", "cell")


def nearest_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bound: int = BOUND, cell: int = CELL, asks: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, digest, nearest_doc_id, difference) of every document; the last two are null where no other document is within the bound.

    asks: of an id, whether its nearest is searched, among all documents; of others the last two are null as well. None: all ask."""
    kind = checked_id(docs, id_col)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    short = slim.where(F.col("text").isNull() | (F.octet_length("text") < MIN_BYTES)).select("id")
    made = slim.where(F.octet_length("text") >= MIN_BYTES).mapInArrow(_digest, f"id {kind}, " + ", ".join(f"{c} long" for c in PLANES) + ", len int, r1 int, r2 int")
    made = written(made, "digests")
    parts = [*PLANES, "len", "r1", "r2"]
    one = made.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(*parts)).alias("d")).select("id", "d.*")
    same = written(one.groupBy(*parts).agg(F.min("id").alias("a"), F.count("*").alias("n"), F.max("id").alias("z")), "same")
    # documents of equal digests are each other's nearest
    many = one.join(same.where("n > 1"), parts)
    second = many.where("id > a").groupBy("a").agg(F.min("id").alias("b"))
    wanted = (lambda i: asks(F.col(i))) if asks else (lambda i: F.lit(True))
    equal = many.where("id > a").selectExpr("id", "a AS other", "0 AS d").union(second.selectExpr("a AS id", "b AS other", "0 AS d")).where(wanted("id"))
    # of equal digests, the least id is there for the others to find
    all_ = same.select(F.col("a").alias("id"), *parts)
    asked = same.where("n = 1").where(wanted("a")).select(F.col("a").alias("id"), *parts)
    found = _met(asked, all_, cell, bound).select("key", "cell", "asking", "id", *parts).mapInArrow(_best(bound), f"id {kind}, other {kind}, d int")
    best = found.union(equal).groupBy("id").agg(F.min(F.struct("d", "other")).alias("m")).select(F.col("id").alias("_id"), F.col("m.other").alias("nearest_doc_id"), F.col("m.d").alias("difference"))
    out = made.select("id", _hex().alias("digest")).join(best, F.col("id") == F.col("_id"), "left").select(F.col("id").alias("doc_id"), "digest", "nearest_doc_id", "difference")
    return out.unionByName(short.select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast(kind).alias("nearest_doc_id"), F.lit(None).cast("int").alias("difference")))
