"""Token ids in training order, as fixed-stride binary shards.

Documents are encoded (byte-level BPE), each followed by an end mark. Their order is that of a hash of id and text, whatever the input's files and partitions are:
its leading bits are buckets of about BUCKET_DOCS documents, however hot a source is, and each bucket, sorted by the hash, is one stream, cut into sequences of `length` tokens, the last of
which is filled up with the end mark. A sequence's index is its place in its bucket after all sequences of earlier buckets. A keyed Feistel permutation with
cycle-walking maps the index, 0 to n - 1, to a slot in the training order: a bijection that any process computes for itself, so nothing is sorted by random numbers and
no table of the order exists. Shard k holds the slots k * per_shard to (k + 1) * per_shard - 1, each of `length` little-endian words of 2 bytes, or 4 where
the vocabulary needs them: a reader seeks to slot * width * length and resumes anywhere. The same documents give the same shards on every cluster, so a run can be resumed on another one.

Cost: the text is read and encoded once; the tokens, compressed, are shuffled once by bucket and once, as sequences, to the range of their slots. Between the two the sequences are a written table,
as their number must be known before any can be placed. Ranges of a permutation of 0 .. n - 1 are known, so no sample is taken.

Defined cases: a null text has no tokens and no end mark; an empty text has the end mark only. Ids can be of any type with an order; null ids, ties and repeated rows need no rule: every
row is a document of its own, named in doc_ids as it is, and rows that are equal in id and text are interchangeable. Strings that look like special tokens are ordinary text. A text of any length is one document.
An empty table gives no sequence. Columns other than the two named don't matter. A token id that the width can't hold is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._kernels import U, mix
from ._shared import checked_id, process_cache, written

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
LENGTH = 2048
PER_SHARD = 4096
KEY = 0x5EED
ROUNDS = 6
#: Documents of a bucket, about.
BUCKET_DOCS = 4096
#: Buckets whose offsets (16 bytes each) are sent to every task; more are joined by a shuffle.
BROADCAST_BUCKETS = 1_000_000
#: Texts longer than this are encoded in parts, cut where no token can cross.
PART_CHARS = 1 << 20


def _round_keys(key: int) -> np.ndarray:
    return mix(np.arange(ROUNDS, dtype=U) + U(key * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def permute(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of the indices x: a keyed permutation of 0 .. n - 1. A balanced Feistel network permutes the next even power of two above; who lands at n or beyond walks on."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = _round_keys(key)
    out = np.asarray(x, np.int64).astype(U)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> U(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        y = (left << U(half)) | right
        out[todo] = y
        todo = todo[y >= U(n)]
    return out.astype(np.int64)


def unpermute(y: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The indices of the slots y."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = _round_keys(key)
    out = np.asarray(y, np.int64).astype(U)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> U(half), out[todo] & mask
        for k in keys[::-1]:
            left, right = right ^ (mix(left ^ k) & mask), left
        x = (left << U(half)) | right
        out[todo] = x
        todo = todo[x >= U(n)]
    return out.astype(np.int64)


def encoder(ranks_path: str):
    cache = process_cache()
    if ("bpe", ranks_path) not in cache:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        cache["bpe", ranks_path] = tiktoken.Encoding("plumbline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache["bpe", ranks_path]


def encode(text: str, ranks_path: str = RANKS) -> np.ndarray:
    bpe = encoder(ranks_path)
    if len(text) <= PART_CHARS:
        return bpe.encode_to_numpy(text, disallowed_special=())
    parts, at = [], 0
    while at < len(text):
        end = at + PART_CHARS
        # a blank between two letters begins a token, whatever surrounds it
        while end < len(text) - 1 and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1].isalpha()):
            end += 1
        end = end if end < len(text) - 1 else len(text)
        parts.append(bpe.encode_to_numpy(text[at:end], disallowed_special=()))
        at = end
    return np.concatenate(parts)


def width_of(ranks_path: str, end: int) -> int:
    """Bytes of a token id: 2 where the whole vocabulary and the end mark fit, else 4."""
    return 2 if max(encoder(ranks_path).max_token_value, end) < 1 << 16 else 4


def _codec() -> pa.Codec:
    cache = process_cache()
    if "zstd" not in cache:
        cache["zstd"] = pa.Codec("zstd", compression_level=1)
    return cache["zstd"]


def _packed(raw: bytes) -> bytes:
    return _codec().compress(raw, asbytes=True)


def _raw(packed: bytes, size: int) -> bytes:
    return _codec().decompress(packed, size, asbytes=True)


def _tokens(ranks_path: str, end: int, width: int):
    """(bucket, key, tie, id, n, packed) of rows (bucket, key, tie, id, text): the tokens of each document with its end mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, out = [], []
            for text in b.column(4).to_pylist():
                ids = np.append(encode(text, ranks_path), end)
                if ids.max() >= 1 << 8 * width:
                    raise ValueError(f"token id {ids.max()} doesn't fit {width} bytes")
                n.append(len(ids))
                out.append(_packed(ids.astype(f"<u{width}").tobytes()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int64()), pa.array(out, pa.binary())], names=["bucket", "key", "tie", "id", "n", "packed"])

    return run


def _sequences(length: int, end: int, width: int):
    """(bucket, local, packed, doc_ids) of rows (bucket, id, n, packed), sorted by bucket: each bucket's stream, cut."""
    step = length * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, local, rest, ids, kind = None, 0, b"", [], None
        out: list[tuple] = []

        def cut(whole: bytes, named: list, last: bool) -> None:
            """Sequences of whole; named has (id, end of its document in whole)."""
            nonlocal local, rest, ids
            n, at = len(whole) // step, 0
            if last and len(whole) > n * step:
                whole += np.full((n + 1) * length - len(whole) // width, end, f"<u{width}").tobytes()
                n += 1
            for k in range(n):
                upto, held = (k + 1) * step, []
                while at < len(named):
                    held.append(named[at][0])
                    if named[at][1] > upto:
                        break
                    at += 1
                    if named[at - 1][1] == upto:
                        break
                out.append((bucket, local, _packed(whole[k * step : upto]), held))
                local += 1
            rest, ids = whole[n * step :], [(i, e - n * step) for i, e in named[at:]]

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.list_(kind))], names=["bucket", "local", "packed", "doc_ids"])
            out.clear()
            return b

        for b in batches:
            kind = b.column(1).type
            parts, size = [rest], len(rest)
            for k, i, n, packed in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if k != bucket:
                    if bucket is not None:
                        cut(b"".join(parts), ids, True)
                    bucket, local, ids, parts, size = k, 0, [], [], 0
                raw = _raw(packed, n * width)
                parts.append(raw)
                size += len(raw)
                ids.append((i, size))
                if size > 8 << 20:
                    cut(b"".join(parts), ids, False)
                    parts, size = [rest], len(rest)
            cut(b"".join(parts), ids, False)
            yield flush()
        if bucket is not None:
            cut(rest, ids, True)
            yield flush()

    return run


def _unpacked(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [_raw(x, length * width) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(raw, pa.binary()), b.column(4)], names=["shard", "slot", "seq", "tokens", "doc_ids"])

    return run


def _place(n: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(permute(np.asarray(b.column(0)), n, key)), *b.columns], names=["slot", "seq", "packed", "doc_ids"])

    return run


def training_sequences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, ranks_path: str = RANKS, end: int = END, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """(shard, slot, seq, tokens, doc_ids): every sequence with its slot in training order, its tokens as little-endian words, and the documents that it has parts of. Partitions are ranges of slots, sorted."""
    kind, width = checked_id(docs, id_col), width_of(ranks_path, end)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    bits = max(0, math.ceil(math.log2(max(1, slim.count()) / bucket_docs)))
    mixed = F.xxhash64(F.lit(1), "id", "text")
    keyed = slim.select((F.shiftrightunsigned(mixed, 64 - bits) if bits else F.lit(0)).cast("long").alias("bucket"), mixed.alias("key"), F.xxhash64(F.lit(2), "text").alias("tie"), "id", "text")
    tokens = keyed.mapInArrow(_tokens(ranks_path, end, width), f"bucket long, key long, tie long, id {kind}, n long, packed binary")
    # a task has 16 buckets at most, about
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 16)
    sorted_ = tokens.repartition(tasks, "bucket").sortWithinPartitions("bucket", "key", "tie", "id").select("bucket", "id", "n", "packed")
    made = written(sorted_.mapInArrow(_sequences(length, end, width), f"bucket long, local long, packed binary, doc_ids array<{kind}>"), "sequences")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each bucket
    offsets = written(made.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    n, buckets = offsets.agg(F.sum("n"), F.count("*")).first()
    n = n or 0
    small = offsets.select("bucket", "offset")
    small = F.broadcast(small) if buckets <= BROADCAST_BUCKETS else small
    placed = made.join(small, "bucket").select(F.expr("`offset` + local").alias("seq"), "packed", "doc_ids").mapInArrow(_place(n, key), f"slot long, seq long, packed binary, doc_ids array<{kind}>")
    shards = max(1, -(-n // per_shard))
    parts = min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // 16)))
    # slots are 0 .. n - 1, each once: equal ranges of whole shards are known without a sample
    ranged = placed.withColumn("shard", F.expr(f"slot div {per_shard}L")).repartitionById(parts, F.expr(f"cast(slot div {per_shard}L * {parts}L div {shards}L AS int)"))
    return ranged.sortWithinPartitions("slot").select("shard", "slot", "seq", "packed", "doc_ids").mapInArrow(_unpacked(length, width), f"shard long, slot long, seq long, tokens binary, doc_ids array<{kind}>")


def write_shards(sequences: DataFrame, path: str, *, length: int = LENGTH, width: int = 2) -> DataFrame:
    """Writes shard files (shard-00000000.bin, fixed stride of width * length bytes) to path and returns (shard, first_slot, sequences, bytes).

    path is a folder that every executor can reach, as a URI that pyarrow has a file system for (file, hdfs, s3, gs, abfs) or a path.
    A file is written under a name of its task attempt and renamed when whole, so a task that runs twice does no harm, and a file that is there is whole. Such a file isn't written again,
    which makes a second call a resumption; one of another size than the sequences need is an error, as path belongs to one set of sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, root = _folder(path)
        fs.create_dir(root, recursive=True)
        state = None

        def close():
            shard, first, count, f, name = state
            final = f"{root}/shard-{shard:08d}.bin"
            if f is not None:
                f.close()
                fs.move(name, final)
            elif fs.get_file_info(final).size != count * width * length:
                raise ValueError(f"{final} is of other sequences")
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([first]), pa.array([count]), pa.array([count * width * length])], names=["shard", "first_slot", "sequences", "bytes"])

        for b in batches:
            for shard, slot, raw in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if state is None or state[0] != shard:
                    if state is not None:
                        yield close()
                    name = f"{root}/.{shard:08d}-{uuid.uuid4().hex}"
                    there = fs.get_file_info(f"{root}/shard-{shard:08d}.bin").size is not None
                    state = [shard, slot, 0, None if there else fs.open_output_stream(name), name]
                if state[3] is not None:
                    state[3].write(raw)
                state[2] += 1
        if state is not None:
            yield close()

    return sequences.select("shard", "slot", "tokens").mapInArrow(run, "shard long, first_slot long, sequences long, bytes long")


def _folder(path: str):
    """(file system, folder) of a URI or a path."""
    import os
    import re

    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+://", path) else os.path.abspath(re.sub(r"^file:/*", "/", path)))


def read_sequences(path: str, first: int, count: int, *, length: int = LENGTH, per_shard: int = PER_SHARD, width: int = 2) -> np.ndarray:
    """(count, length) token ids of the slots from first on, by seeking; fewer rows where the shards end."""
    fs, root = _folder(path)
    out = []
    while count > 0:
        shard, at = divmod(first, per_shard)
        name = f"{root}/shard-{shard:08d}.bin"
        here = min(count, per_shard - at)
        if fs.get_file_info(name).size is None:
            break
        with fs.open_input_file(name) as f:
            f.seek(at * width * length)
            got = np.frombuffer(f.read(here * width * length), f"<u{width}").reshape(-1, length)
        out.append(got)
        if len(got) < here:
            break
        first, count = first + here, count - here
    return np.concatenate(out) if out else np.zeros((0, length), f"<u{width}")


def shards_read_back(index: DataFrame, path: str, *, length: int = LENGTH, per_shard: int = PER_SHARD, width: int = 2) -> DataFrame:
    """(slot, sha256) of every sequence in the shards that write_shards has listed, each read by seeking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            for first, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = read_sequences(path, first, n, length=length, per_shard=per_shard, width=width)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(got))), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in got])], names=["slot", "sha256"])

    return index.select("first_slot", "sequences").mapInArrow(run, "slot long, sha256 string")
