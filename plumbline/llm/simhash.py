"""Near-duplicate documents by SimHash, compared bit-sliced.

A document's signature has 256 bits, each the majority over its set of word pairs. Which documents are compared at all is
settled by minwise keys over the same set: two documents meet where both minima of any of KEYS key pairs agree. Where they
meet, signatures are held as bit planes (plane k holds bit k of 64 documents in each word), and the distances of all lanes to
a query grow together in carry-save counters, one plane after the other; words whose 64 lanes have all passed the radius are
abandoned. Documents within the radius are linked, and the connected components of the links are the groups.

Cost: the text is read once, in numpy; a document then weighs about 130 bytes. One shuffle by signature (equal signatures
collapse there, so thousands of copies cost one comparison), one by key, and a few small ones for the components. A bucket of
more than CELL signatures is cut into parts of which every two meet in a cell of their own, so that no task has more than
2 * CELL signatures to compare, and no candidate is left out.

Defined cases: ids can be of any type with an order. A null text or one without letters and digits has no signature and is in no group. Rows that share a doc_id
count as one document. A row with a null doc_id can't be named as a partner: it is in no group, and near_dedup keeps it. Further
columns of any name pass through near_dedup untouched. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import U, mix, pair_set, slices, words
from ._shared import checked_id, drop_written, meeting_cells, written

KEYS = 12
RADIUS = 66
CELL = 20_000
SMALL = 200
BITS = 256
WORDS = BITS // 64
SIG = [f"s{w}" for w in range(WORDS)]
_SEEDS = mix(np.arange(1000, 1000 + 2 * KEYS, dtype=U))
_SPREAD = np.packbits((np.arange(256)[:, None, None] >> np.arange(8)[None, :, None] & 1) * (np.arange(8) == 0), axis=2, bitorder="little")[..., 0].copy().view(U)[:, 0]
_EMPTY = np.zeros(0, np.int64)


def votes(f: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The majority of each of BITS hash bits over the features of each row. Eight bits are counted at once, in the bytes of a word, over
    at most 255 features; these parts are then added up."""
    parts = -(-size // 255)
    last = np.cumsum(parts)
    cut = np.repeat(begin, parts) + 255 * (np.arange(last[-1]) - np.repeat(last - parts, parts))
    sig = np.empty((len(begin), WORDS), U)
    for w in range(WORDS):
        octets = mix(f + U(w + 1)).view(np.uint8).reshape(-1, 8)
        for o in range(8):
            few = np.add.reduceat(_SPREAD[octets[:, o]], cut).view(np.uint8).reshape(-1, 8)
            n = np.add.reduceat(few, last - parts, axis=0, dtype=np.int32)
            sig.view(np.uint8)[:, 8 * w + o] = np.packbits(2 * n > size[:, None], axis=1, bitorder="little")[:, 0]
    return sig


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature as two words, keys) of the rows that have any word."""
    rows, sigs, keys = [], [], []
    for lo, _, buf, offs in slices(column):
        f, r = pair_set(*words(buf, offs))
        if not len(f):
            continue
        begin = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        size = np.diff(np.append(begin, len(r)))
        sig = votes(f, begin, size)
        key = np.empty((len(begin), KEYS), U)
        for k in range(KEYS):
            a, b = (np.minimum.reduceat((f ^ _SEEDS[2 * k + i]) * (_SEEDS[2 * k + i] | U(1)), begin) for i in range(2))
            key[:, k] = mix(a * U(31) + b + U(k))
        rows.append(r[begin] + lo)
        sigs.append(sig)
        keys.append(key)
    if not rows:
        return _EMPTY, np.zeros((0, WORDS), U), np.zeros((0, KEYS), U)
    return np.concatenate(rows), np.concatenate(sigs), np.concatenate(keys)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, sig, keys = signatures(b.column(1))
        at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * KEYS)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(rows)), *(pa.array(np.ascontiguousarray(sig[:, w]).view(np.int64)) for w in range(WORDS)), pa.ListArray.from_arrays(at, pa.array(keys.reshape(-1).view(np.int64)))],
            names=["id", *SIG, "keys"],
        )


def planes(sig: np.ndarray) -> np.ndarray:
    """(BITS, words): plane k has bit k of 64 signatures in each word; the last word is padded with zeros."""
    n = len(sig)
    bits = np.unpackbits(np.ascontiguousarray(sig).view(np.uint8).reshape(n, 8 * WORDS), axis=1, bitorder="little")
    wide = np.zeros((BITS, -(-n // 64) * 64), np.uint8)
    wide[:, :n] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view(U)


def within(differ, width: int, radius: int) -> np.ndarray:
    """Words of lanes whose distance is at most the radius.

    differ(k, alive) gives plane k of the differences in the words numbered by alive. Each lane's counter is a stack of bit
    planes; three planes go in by one full adder, whose carry ripples on. After every 12 planes the words in which all lanes
    have passed the radius leave."""
    depth = BITS.bit_length()
    out, alive = np.zeros(width, U), np.arange(width)
    count = np.zeros((depth, width), U)
    for k in range(0, BITS, 3):
        a = differ(k, alive)
        if k + 2 < BITS:
            b, c = differ(k + 1, alive), differ(k + 2, alive)
            ab = a ^ b
            low, high = ab ^ c, (a & b) | (ab & c)
        elif k + 1 < BITS:
            b = differ(k + 1, alive)
            low, high = a ^ b, a & b
        else:
            low, high = a, None
        carry = count[0] & low
        count[0] ^= low
        if high is not None:
            # the counter's second plane takes the carry of the first and the adder's high bit
            t = count[1]
            th = t ^ high
            count[1], carry = th ^ carry, (t & high) | (th & carry)
            level = 2
        else:
            level = 1
        while level < depth and carry.any():
            nxt = count[level] & carry
            count[level] ^= carry
            carry = nxt
            level += 1
        if k % 12 == 9 and k > radius:
            keep = ~_above(count, radius) != 0
            if not keep.all():
                alive, count = alive[keep], np.ascontiguousarray(count[:, keep])
                if not len(alive):
                    return out
    out[alive] = ~_above(count, radius)
    return out


def _above(count: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is greater than the radius, from the highest plane down."""
    more, equal = np.zeros(count.shape[1], U), np.full(count.shape[1], ~U(0))
    for level in range(len(count) - 1, -1, -1):
        if radius >> level & 1:
            equal &= count[level]
        else:
            more |= equal & count[level]
            equal &= ~count[level]
    return more


def _lanes(mask: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[:n])


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) are within the radius; a lane is a pair."""
    if not len(a):
        return _EMPTY
    x = planes(a ^ b)
    return _lanes(within(lambda k, alive: x[k][alive], x.shape[1], radius), len(a))


def near_one(query: np.ndarray, vertical: np.ndarray, n: int, radius: int) -> np.ndarray:
    """Which of n signatures, given as planes, are within the radius of the query."""
    q = np.unpackbits(np.ascontiguousarray(query).view(np.uint8), bitorder="little").astype(bool)
    return _lanes(within(lambda k, alive: ~vertical[k][alive] if q[k] else vertical[k][alive], vertical.shape[1], radius), n)


def links(sig: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the connected components of one bucket: each signature is a query once, against those not yet reached."""
    n = len(sig)
    left, a, b, front = np.arange(n), [], [], []
    held, vertical = left, planes(sig)
    while len(left):
        if not front:
            front, left = [left[0]], left[1:]
        q = front.pop()
        if len(held) > 2 * len(left) + 64:
            held, vertical = left, planes(sig[left])
        hit = held[near_one(sig[q], vertical, len(held), radius)]
        new = hit[np.isin(hit, left, assume_unique=True)]
        if len(new):
            a += [q] * len(new)
            b += new.tolist()
            front += new.tolist()
            left = np.setdiff1d(left, new, assume_unique=True)
    return np.array(a, np.int64), np.array(b, np.int64)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
                if sum(x.num_rows for x in held) < 50_000:
                    continue
                done, rest = _whole_buckets(pa.Table.from_batches(held), False)
                held = rest.to_batches() if rest.num_rows else []
                yield from _bucket_links(done, radius)
        if held:
            yield from _bucket_links(pa.Table.from_batches(held), radius)

    return run


def _whole_buckets(t: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
    cell = t.column("cell").to_numpy()
    key = t.column("key").to_numpy()
    cut = int(np.flatnonzero((key != key[-1]) | (cell != cell[-1]))[-1]) + 1 if ((key != key[-1]) | (cell != cell[-1])).any() else 0
    return t.slice(0, cut), t.slice(cut)


def _bucket_links(t: pa.Table, radius: int) -> Iterator[pa.RecordBatch]:
    if not t.num_rows:
        return
    key, cell = (t.column(c).to_numpy() for c in ("key", "cell"))
    named = t.column("id").combine_chunks().dictionary_encode()
    ids = np.asarray(named.indices)
    sig = np.stack([t.column(c).to_numpy().view(U) for c in SIG], axis=1)
    begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
    size = np.diff(np.append(begin, len(key)))
    a, b = [], []
    for s in range(2, SMALL + 1):  # small buckets: all pairs of all buckets of a size, side by side
        first = begin[size == s]
        i, j = np.triu_indices(s, 1)
        step = max(1, 60_000 // len(i))
        for some in range(0, len(first), step):
            x = (first[some : some + step, None] + i[None]).reshape(-1)
            y = (first[some : some + step, None] + j[None]).reshape(-1)
            hit = near_pairs(sig[x], sig[y], radius)
            a.append(ids[x[hit]])
            b.append(ids[y[hit]])
    for k in np.flatnonzero(size > SMALL):
        x, y = links(sig[begin[k] : begin[k] + size[k]], radius)
        a.append(ids[begin[k] + x])
        b.append(ids[begin[k] + y])
    a, b = (np.concatenate(v) if v else _EMPTY for v in (a, b))
    edge = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
    yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(edge[:, k])) for k in range(2)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node u of the edges that isn't the least of its connected component, with that least node v.

    Alternating large and small stars: a logarithmic number of rounds, each linear in the edges; every round is a written table."""
    now = written(edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "stars")
    state = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m")), F.struct(F.col("v").alias("x"), F.col("m")))).alias("e")).select(F.col("e.x").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        nxt = written(small, "stars")
        row = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        drop_written(now)
        now, before, state = nxt, state, tuple(row)
        if state == before:
            return now


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(doc_id, kept_doc_id): each document that has a near duplicate of a smaller id in its group, with the group's least id. Ids can be of any type with an order."""
    kind = checked_id(docs, id_col)
    sign = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(_sign, f"id {kind}, {', '.join(f'{c} long' for c in SIG)}, keys array<long>")
    sign = written(sign, "signatures")
    rep = sign.groupBy(*SIG).agg(F.min("id").alias("rep"), F.min_by("keys", "id").alias("keys"), F.max("id").alias("top"))
    rep = written(rep, "distinct")
    equal = sign.join(rep.where("top > rep").select(*SIG, "rep"), SIG).where("id > rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    keyed = rep.select("rep", *SIG, F.explode("keys").alias("key"))
    met = meeting_cells(keyed.withColumnRenamed("rep", "id"), ["key"], "id", cell).select("key", "cell", "id", *SIG)
    near = met.mapInArrow(_compare(radius), f"u {kind}, v {kind}")
    out = components(equal.union(near))
    drop_written(sign, rep)
    return out.select(F.col("u").alias("doc_id"), F.col("v").alias("kept_doc_id"))


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without the documents that near_duplicates drops: of each group the least id stays."""
    drop = near_duplicates(docs, id_col=id_col, text_col=text_col, radius=radius).select(F.col("doc_id").alias("plumbline_dropped"))
    return docs.join(drop, docs[id_col] == drop["plumbline_dropped"], "left_anti")
