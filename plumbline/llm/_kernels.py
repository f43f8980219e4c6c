"""numpy kernels over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20

_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalnum() or _b >= 0x80:
        _CLASS[_b] = 1
for _b in range(0xE3, 0xEE):
    _CLASS[_b] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, U), dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `most` bytes; a row is never divided. A null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word in order. A word is a run of letters and digits, folded to lower case (ASCII and Latin-1);
    an ideograph or kana is a word of its own."""
    n = len(buf)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    kind = _CLASS[buf]
    folded = _FOLD[buf]
    after = np.zeros(n, np.uint8)
    after[1:] = buf[:-1]
    folded = np.where((after == 0xC3) & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97), buf + np.uint8(0x20), folded)
    signs = np.flatnonzero((buf[:-1] == 0xE2) & (buf[1:] == 0x80)) if n > 1 else np.zeros(0, np.int64)
    for k in range(3):
        kind[np.minimum(signs + k, n - 1)] = 0
    latin = np.flatnonzero(buf == 0xC2)
    kind[latin] = 0
    kind[np.minimum(latin + 1, n - 1)] = 0
    inside = kind > 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offs[:-1][offs[:-1] < n]
    start[first] |= inside[first]
    ideographs = np.flatnonzero(kind == 2)
    start[ideographs] = True
    follow = ideographs + 3
    follow = follow[follow < n]
    start[follow] |= inside[follow]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, U), np.zeros(0, np.int64)
    begin = np.flatnonzero(start[at])
    length = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, length)
    h = np.add.reduceat((folded[at].astype(U) + U(1)) * _POWER[place & 4095], begin)
    row = np.searchsorted(offs, at[begin], side="right") - 1
    return mix(h), row


def pair_set(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row): the set of word pairs of each row, rows ascending; the word itself where a row has only one."""
    if not len(h):
        return h, row
    same = row[1:] == row[:-1]
    alone = np.ones(len(h), bool)
    alone[1:] &= ~same
    alone[:-1] &= ~same
    f = np.concatenate([mix(h[:-1] * U(0xD6E8FEB86659FD93) + h[1:])[same], h[alone]])
    r = np.concatenate([row[:-1][same], row[alone]]).astype(U)
    key = np.sort((r << U(42)) | (f >> U(22)))
    key = key[np.append(True, key[1:] != key[:-1])]
    return mix(key & U((1 << 42) - 1)), (key >> U(42)).astype(np.int64)
