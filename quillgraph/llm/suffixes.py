"""Suffix-array substring deduplication.

Every byte covered by a string of WINDOW bytes that also starts elsewhere is
removed.  Window starts are dealt out by the smallest hash of a GRAM-byte
gram within the window: equal windows share it, wherever they are, so each
hash's windows can be sorted by themselves.  Consecutive windows of one hash
form a run; a run's text is its context.  Equal contexts are kept once with
their number.  Where a hash has several contexts, a suffix array over them
decides: suffixes smaller than their successor are sorted directly, the rest
are induced by scanning the buckets, and adjacent common prefixes of WINDOW
bytes mark the repeated windows.  A hash with more contexts than one task
should sort is split: its contexts are texts that are dealt out again, by the
smallest hash of another hash function.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .joins import spread_lookup
from .storage import Scratch

WINDOW, GRAM = 200, 64
#: Bytes of one suffix array, unless one hash has more; contexts of a hash beyond which it is split, and how often at most
#: (contexts that still share all of their smallest hashes then differ in a few bytes at their rims; they are sorted together).
BATCH, HOT, SPLITS = 1 << 19, 4_000, 4
#: No UTF-8 text has this byte.
BREAK = 0xFF
_NULL_ID = -(1 << 63)


def _gram_values(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from every position on (len - GRAM + 1 of them), by doubling; another one for each seed."""
    h = data.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    size, mult = 1, 0xBF58476D1CE4E5B9
    while size < GRAM:
        h = h[:-size] * np.uint64(mult) + h[size:]
        h ^= h >> np.uint64(31)
        mult = (mult * mult + 2) % (1 << 64) | 1
        size *= 2
    return K.mix(h)


def window_runs(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive window starts with the same smallest gram hash: (row, first start, starts, that hash, whether it occurs twice within).

    Equal windows have the same smallest hash, wherever they are, so windows
    of different hashes never need comparing.  Starts are offsets in data.
    """
    n = len(data)
    if n < window:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z > 0
    grams = low = _gram_values(data, seed)
    width, step = window - GRAM + 1, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[: n - window + 1], low[width - step : width - step + n - window + 1])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - window + 1]
    ok = np.arange(n - window + 1) + window <= offsets[row + 1]
    change = np.ones(len(low), bool)
    change[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]
    start = np.flatnonzero(change & ok)
    # a run ends where the next change or a start outside its row comes
    stops = np.flatnonzero(change | ~ok)
    end = np.append(stops, len(low))[np.searchsorted(stops, start, "right")]
    size, key = end - start, low[start]
    span = size + width - 1  # grams of the run's windows
    before = np.cumsum(span) - span
    equal = grams[np.arange(int(span.sum())) + np.repeat(start - before, span)] == np.repeat(key, span)
    twice = np.add.reduceat(equal, before, dtype=np.int64) > 1 if len(start) else np.zeros(0, bool)
    return row[start], start, size, key, twice


def _big_endian(text: bytes, depth: int) -> np.ndarray:
    """The eight bytes from every position on as one number; zeros follow the text."""
    padded = np.frombuffer(text + bytes(depth + 16), np.uint8)
    word = np.zeros(len(text) + depth + 8, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(word)]
    return word


def _sorted_directly(word: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """starts by their first ``depth`` bytes, eight at a time, among those that are still equal; of two that agree up to the text's end the shorter comes first."""
    at = starts[::-1]
    group = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for k in range(0, depth, 8):
        key = word[at[live] + k]
        order = np.lexsort((key, group[live]))
        at[live] = at[live][order]
        key = key[order]
        new = np.ones(len(live), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[live][1:] != group[live][:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(live)))
        group[live] = live[np.repeat(head, size)]
        live = live[np.repeat(size > 1, size)]
        if not len(live):
            break
    return at


def suffix_array(text: bytes, depth: int = WINDOW) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` bytes at least, by two-stage sorting."""
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    rise = np.empty(n, np.int8)
    rise[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    rise[-1] = -1  # its successor is the empty suffix
    told = np.where(rise != 0, np.arange(n), n)
    smaller = rise[np.minimum.accumulate(told[::-1])[::-1]] > 0  # than its successor
    direct = np.flatnonzero(smaller)
    direct = _sorted_directly(_big_endian(text, depth), direct.copy(), depth)
    count, count_direct = np.bincount(t, minlength=256), np.bincount(t[direct], minlength=256)
    end = np.cumsum(count)
    begin = end - count
    out = np.empty(n, np.int64)
    at = np.cumsum(count_direct) - count_direct
    for c in np.flatnonzero(count_direct):
        out[end[c] - count_direct[c] : end[c]] = direct[at[c] : at[c] + count_direct[c]]
    fill = begin.copy()
    last = t[n - 1]
    out[fill[last]] = n - 1  # induced by the empty suffix
    fill[last] += 1
    for c in np.flatnonzero(count):
        done = begin[c]
        while done < fill[c]:  # those induced from their own bucket: one wave for each repeat of the byte
            prev = out[done : fill[c]] - 1
            done = fill[c]
            prev = prev[prev >= 0]
            prev = prev[(t[prev] == c) & ~smaller[prev]]
            out[fill[c] : fill[c] + len(prev)] = prev
            fill[c] += len(prev)
        prev = out[begin[c] : end[c]] - 1
        prev = prev[prev >= 0]
        prev = prev[(t[prev] > c) & ~smaller[prev]]
        if len(prev):
            first = t[prev]
            prev = prev[np.argsort(first, kind="stable")]
            size = np.bincount(first, minlength=256)
            at = 0
            for d in np.flatnonzero(size):
                out[fill[d] : fill[d] + size[d]] = prev[at : at + size[d]]
                fill[d] += size[d]
                at += size[d]
    return out


def common_prefixes(text: bytes, order: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, ``depth`` at most; 0 for the first."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    word = _big_endian(text, depth)
    a, b, live = order[:-1], order[1:], np.arange(n - 1)
    for k in range(0, depth, 8):
        differ = word[a + k] ^ word[b + k]
        same = differ == 0
        other = differ[~same]
        out[live[~same] + 1] = k + sum((other < np.uint64(1 << s)).astype(np.int64) for s in range(56, 0, -8))
        a, b, live = a[same], b[same], live[same]
        if not len(live):
            break
    out[live + 1] = depth
    return np.minimum(np.minimum(out, depth), n - np.maximum(order, np.concatenate([[0], order[:-1]])))


def repeated_starts(contexts: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Over the contexts laid out one after the other, each with a break: whether the window at a byte starts elsewhere too."""
    text = bytes([BREAK]).join(contexts) + bytes([BREAK])
    order = suffix_array(text, window)
    same = np.flatnonzero(common_prefixes(text, order, window) >= window)
    out = np.zeros(len(text), bool)
    out[order[same]] = True
    out[order[same - 1]] = True
    return out


_RUNS = "key long, ctx long, cty long, did long, th long, s int, n int, twice boolean, times long"


def _emit_runs(level: int):
    """Runs of every text (did, th, times, text); a context is named by the smallest hash and 128 bits of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th, times = (batch.column(c).to_numpy() for c in ("did", "th", "times"))
            for i, _, data, offsets in K.chunks(*K.buffers(batch.column("text"))):
                row, start, size, key, twice = window_runs(data, offsets, seed=level)
                if level:  # windows of different hashes so far stay apart
                    key = K.mix(key ^ K.mix(did[i + row].view(np.uint64)))
                end = start + size + WINDOW - 1
                ctx = K.span_hashes(data, start, end)
                cty = K.span_hashes(np.ascontiguousarray(data[::-1]), len(data) - end, len(data) - start, 5)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (key.view(np.int64), ctx.view(np.int64), cty.view(np.int64), did[i + row], th[i + row], (start - offsets[row]).astype(np.int32), size.astype(np.int32), twice, times[i + row])],
                    [f.split()[0] for f in _RUNS.split(", ")],
                )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their shuffle."""
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        data, offsets = K.buffers(batch.column("text"))
        out = [codec.compress(data[a:b].tobytes(), asbytes=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        rest = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.binary()), pa.array(np.diff(offsets))], [*[c for c in batch.schema.names if c != "text"], "z", "n_bytes"])


def _unpack(codec: pa.Codec, z: bytes, n: int) -> bytes:
    return codec.decompress(z, n, asbytes=True) if n else b""


_CONTEXT = ["key", "ctx", "cty", "times", "contexts"]


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ctx, cty, times, contexts, bytes) of the runs in a text's list."""
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        for z, n, runs in zip(batch.column("z").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            text = _unpack(codec, z, n)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[c] for r in runs], pa.int64()) for c in _CONTEXT), pa.array([text[r["s"] : r["s"] + r["n"] + WINDOW - 1] for r in runs], pa.binary())],
                [*_CONTEXT, "bytes"],
            )


def _spans(flags: np.ndarray) -> list[list[int]]:
    s, e, _ = K.runs(flags, np.array([0, len(flags)]))
    return np.stack([s, e], 1).tolist()


def _sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked starts of every context: rows come ordered by key, whole keys to a partition."""

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        flags, at, out = repeated_starts([r[4] for r in rows]), 0, []
        for *_, times, text in rows:
            starts = flags[at : at + len(text) - WINDOW + 1]
            out.append([[0, len(starts)]] if times > 1 else _spans(starts))
            at += len(text) + 1
        return pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], pa.int64()) for c in range(3)), pa.array(out, pa.list_(pa.list_(pa.int32())))], ["key", "ctx", "cty", "marks"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "ctx", "cty", "times", "bytes")), strict=True):
            if size >= BATCH and row[0] != held[-1][0]:
                yield solved(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4]) + 1
    if held:
        yield solved(held)


def _marks(texts: DataFrame, scratch: Scratch, hot: int, level: int = 0) -> DataFrame:
    """(did, th, marks) of the texts (did, th, times, text) with repeated windows; a text that occurs several times has all of its windows twice."""
    runs = scratch.keep(texts.mapInArrow(_emit_runs(level), _RUNS), f"runs-{level}")
    keys = runs.groupBy("key").agg(F.sum("times").alias("t"), F.max("twice").alias("twice"), F.count(F.lit(1)).alias("c")).filter("t > 1 or twice")
    again = spread_lookup(runs, keys.select("key", "c", F.lit(True).alias("met")), "key", "c", runs.count()).filter("met").drop("met")
    again = scratch.keep(again, f"again-{level}")
    scratch.drop(f"runs-{level}")
    one = again.groupBy("key", "ctx", "cty").agg(F.sum("times").alias("times"), F.max("twice").alias("twice"), F.min(F.struct("did", "th", "s", "n")).alias("rep"))
    one = scratch.keep(one, f"distinct-{level}")
    per = one.groupBy("key").agg(F.count(F.lit(1)).alias("contexts"))
    one = scratch.keep(spread_lookup(one, per.withColumn("c", F.col("contexts")), "key", "c", one.count()), f"contexts-{level}")
    scratch.drop(f"distinct-{level}")
    many = one.filter("contexts > 1 or times = 1")  # one context that occurs once repeats within
    lists = many.groupBy("rep.did", "rep.th").agg(F.collect_list(F.struct(*_CONTEXT, F.col("rep.s").alias("s"), F.col("rep.n").alias("n"))).alias("runs"))  # of one text
    held = texts.select("did", "th", "text").mapInArrow(_pack, "did long, th long, z binary, n_bytes long").join(lists, ["did", "th"])
    cut = held.select("z", "n_bytes", "runs").mapInArrow(_cut_contexts, "key long, ctx long, cty long, times long, contexts long, bytes binary")
    cut = scratch.keep(cut, f"bytes-{level}")
    marks = "key long, ctx long, cty long, marks array<array<int>>"
    last = level == SPLITS
    cold = cut if last else cut.filter(F.col("contexts") <= hot)
    cold = cold.dropDuplicates(["key", "ctx", "cty"])  # a repeated row gives its contexts twice
    found = cold.repartition("key").sortWithinPartitions("key", "ctx", "cty").mapInArrow(_sort_contexts, marks)
    large = cut.filter(F.col("contexts") > hot)
    if not last and not large.isEmpty():
        large = scratch.keep(large.dropDuplicates(["key", "ctx", "cty"]).withColumn("th", F.xxhash64("ctx", "cty")), f"large-{level}")
        inner = _marks(large.select(F.col("key").alias("did"), "th", "times", F.col("bytes").alias("text")), scratch, hot, level + 1)
        whole = F.when(F.col("times") > 1, F.array(F.array(F.lit(0), (F.octet_length("bytes") - WINDOW + 1).cast("int"))))
        inner = large.join(inner.select(F.col("did").alias("key"), "th", "marks"), ["key", "th"], "left").withColumn("marks", F.coalesce(whole, "marks"))
        found = found.unionByName(inner.filter("marks is not null").select("key", "ctx", "cty", "marks"))
    whole = one.filter("contexts = 1 and times > 1").select("key", "ctx", "cty", F.array(F.array(F.lit(0), F.col("rep.n"))).alias("marks"))
    found = found.filter(F.size("marks") > 0).unionByName(whole)
    placed = F.transform("marks", lambda m: F.array(m[0] + F.col("s"), m[1] + F.col("s")))
    return again.join(found, ["key", "ctx", "cty"]).groupBy("did", "th").agg(F.flatten(F.collect_list(placed)).alias("marks"))


def find_spans(docs: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """(did, th, marks): runs [first, end) of repeated window starts of every text that has any; did and th name the text."""
    return _marks(_named(docs).withColumn("times", F.lit(1).cast("long")), scratch, hot)


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def remove_repeats(docs: DataFrame, scratch: Scratch, keep_text: bool = False, hot: int = HOT, carry: list[str] | None = None, as_text: bool = False, prefix: str = "") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and with keep_text the spans and the kept bytes; columns named in carry pass through;
    with as_text the kept bytes are decoded, without characters cut in part; prefix goes before all names but doc_id.

    Texts are UTF-8 bytes, a null is empty; matches don't cross texts.  A
    repeated row is a text that starts elsewhere too, so both lose all
    windows.  Texts under WINDOW bytes lose nothing; an empty table gives no
    rows; other columns are not read.
    """
    spans = find_spans(docs, scratch, hot)
    text, own = F.coalesce("text", F.lit("")), carry or []
    rows = docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("__did"), F.xxhash64(text).alias("__th"), *[F.col(c).alias(f"__own_{c}") for c in own], text.alias("text"))
    fields = [rows.schema[f"__own_{c}"] for c in own]
    packed = rows.mapInArrow(_pack, T.StructType([*rows.schema.fields[:-1], T.StructField("z", T.BinaryType()), T.StructField("n_bytes", T.LongType())]))
    packed = packed.join(spans.withColumnsRenamed({"did": "__did", "th": "__th"}), ["__did", "__th"], "left")
    made = T._parse_datatype_string("did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<long>>, kept binary" * keep_text)
    if as_text:
        made = T.StructType([*made.fields[:-1], T.StructField("kept", T.StringType())])
    schema = T.StructType([*made.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            rows: list[tuple] = []
            for did, z, n, marks in zip(*(batch.column(c).to_pylist() for c in ("__did", "z", "n_bytes", "marks")), strict=True):
                text, gone = _unpack(codec, z, n), []
                for a, b in sorted(marks or ()):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b + WINDOW - 1)
                    else:
                        gone.append([a, b + WINDOW - 1])
                at, kept = 0, []
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                left = b"".join([*kept, text[at:]]) if gone else text
                rows.append((did, n, n - len(left), len(gone), hashlib.sha256(left).hexdigest(), *((gone, left.decode(errors="ignore") if as_text else left) if keep_text else ())))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.string() if as_text else pa.binary()]
            names = ["did", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            columns = list(zip(*rows, strict=True)) if rows else [()] * (5 + 2 * keep_text)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[: len(columns)]) if not own else pa.RecordBatch.from_arrays(
                [*[pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], *[batch.column(f.name) for f in fields]], [*names[: len(columns)], *[f.name for f in fields]]
            )

    out = packed.mapInArrow(run, schema)
    out = out.withColumn("did", F.nullif(F.col("did"), F.lit(_NULL_ID)))
    told = {c: prefix + c for c in out.columns if c != "did" and not c.startswith("__own_")}
    return out.withColumnsRenamed({"did": "doc_id"} | told | {f"__own_{c}": c for c in own})
