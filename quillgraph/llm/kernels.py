"""Byte-level kernels shared by the text operators.

Every kernel works on the raw buffers of an Arrow string column: one flat
uint8 array and its row offsets.  No Python string is made, so the cost is a
few vector passes over the bytes.  Rows are cut into chunks of about
``CHUNK`` bytes to bound memory; one text is never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown and kept per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + (CHUNK >> 1))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (all bits depend on all bits)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    out = data.copy()
    upper = (out >= 65) & (out <= 90)
    out[upper] += 32
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross rows: starts, ends, and the number of runs of each row."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~first[:n]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~first[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as starts, ends, words per row."""
    return runs(~_SPACE[data], offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, from one cumulative polynomial."""
    n = len(data)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, n), out=acc[1:])
    h = (acc[ends] - acc[starts]) * powers(_PINV, n + 1)[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)
    return mix(h)


_Q = np.uint64(0xA24BAED4963EE407)


def gram_hashes(hashes: np.ndarray, counts: np.ndarray, n: int, whole_short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each row's sequence.

    counts: items per row.  Returns the hashes, their number per row and each
    gram's first item.  whole_short: a row of 1 to n-1 items has its whole
    sequence as its one gram.
    """
    total = len(hashes)
    ends = np.cumsum(counts)
    begin = ends - counts
    per = np.maximum(counts - n + 1, 0)
    at = np.arange(int(per.sum()), dtype=np.int64) + np.repeat(begin - (np.cumsum(per) - per), per)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out * _Q + hashes[at + k]
    out = mix(out + np.uint64(n))
    if whole_short and total:
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            extra = np.empty(len(short), np.uint64)
            for size in range(1, n):
                rows = np.flatnonzero(counts[short] == size)
                h = np.zeros(len(rows), np.uint64)
                for k in range(size):
                    h = h * _Q + hashes[begin[short[rows]] + k]
                extra[rows] = mix(h + np.uint64(size))
            where = (np.cumsum(per) - per)[short]
            out = np.insert(out, where, extra)
            at = np.insert(at, where, begin[short])
            per[short] = 1
    return out, per, at


def distinct_per_row(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their number per row."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], np.bincount(r[keep], minlength=len(counts)).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles (hashed) of each row of lower-cased words; a shorter text is one shingle."""
    low = lower_ascii(data)
    s, e, per = words(low, offsets)
    grams, counts, _ = gram_hashes(span_hashes(low, s, e), per, n, whole_short=True)
    return distinct_per_row(grams, counts)
