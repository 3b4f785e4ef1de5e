"""Substring deduplication by paragraphs: MinHash banding, exact Jaccard, components.

Paragraphs are lines.  Banding tuned to the similarity finds pairs of lines
that may reach it, their full shingle sets decide, links make components, and
each component's first line, by doc_id and place, stays.

So that a passage inside a line, or over several, is met too, lines are cut
where their own words say so: before the word whose trigram hash is the least
within REACH words to either side.  Equal passages have equal cuts, wherever
they stand, and what lies between two cuts is a block, a unit like a line that
is in a component with those of an equal shingle set (a block another than by
a word at its rim is below the similarity anyway).  Next to a line or block
that occurs again, the words that follow (or precede) it in two places alike,
are its rim, as far as they aren't in such a unit themselves.  What adjoining linked lines, blocks and rims cover is a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .joins import spread_lookup
from .nearness import candidate_groups, distinct_classes, linked, set_hashes
from .storage import Scratch
from .suffixes import _NULL_ID, _pack, _unpack

WORDS, PERCENT, REACH = 5, 80, 9
#: Words of a stretch from which it is a passage; blocks inside lines are only removed within passages.
PASSAGE = 50
#: Most pairs at the threshold, as a part, that no band brings together; most minhash values of a line.
MISS, HASHES = 0.005, 32
_END = np.uint64(0xFFFFFFFFFFFFFFFF)


def tuned_bands(similarity: float = PERCENT / 100, miss: float = MISS, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows with which bands * rows <= hashes miss a pair at the threshold with at most this probability."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = int(np.ceil(np.log(miss) / np.log1p(-(similarity**rows))))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def agreement(similarity: float, hashes: int) -> int:
    """Minhash values that pairs at the threshold share, less 3.6 standard deviations."""
    return int(similarity * hashes - 3.6 * np.sqrt(hashes * similarity * (1 - similarity)))


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of the bands over minhash values."""
    keys = np.zeros((len(low), bands), np.uint64)
    for b in range(bands):
        keys[:, b] = b + 1
        for k in range(rows):
            keys[:, b] = K.mix(keys[:, b] * np.uint64(31) + low[:, b * rows + k])
    return keys


def minima(values: np.ndarray, counts: np.ndarray, hashes: int) -> np.ndarray:
    """Minhash values of non-empty sets laid out one after the other, the low 16 bits of each."""
    begin = np.cumsum(counts) - counts
    rng = np.random.default_rng(10)
    seeds = rng.integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if not len(counts):
        return np.zeros((0, hashes), np.uint16)
    return np.stack([(np.minimum.reduceat(K.mix(values * s), begin) & np.uint64(0xFFFF)).astype(np.uint16) for s in seeds], 1)


@dataclass
class Units:
    """Lines and blocks of a chunk of texts, in the order of their places; word numbers and bytes count from the chunk's start."""

    row: np.ndarray
    first: np.ndarray  # word
    size: np.ndarray  # words
    line: np.ndarray  # or else a block
    starts: np.ndarray  # first words of the parts that lines are cut into
    hashes: np.ndarray  # of all words
    words: tuple[np.ndarray, np.ndarray]  # their starts and ends
    per: np.ndarray  # words of each row


def cut(data: np.ndarray, offsets: np.ndarray, reach: int = REACH) -> Units:
    """Units of every text: lines with a word, and their parts between two cuts."""
    low = K.lower_ascii(data)
    s, e, per = K.words(low, offsets)
    h = K.span_hashes(low, s, e)
    row = np.repeat(np.arange(len(per)), per)
    n = len(s)
    if not n:
        z = np.zeros(0, np.int64)
        return Units(z, z, z, z > 0, z, h, (s, e), per)
    feeds = np.cumsum(low == 10)[s]
    new = np.ones(n, bool)
    new[1:] = (feeds[1:] != feeds[:-1]) | (row[1:] != row[:-1])
    line_no = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, n))
    grams, _, at = K.gram_hashes(h, length, 3)
    # lines one after the other, apart by as many end marks as the search reaches
    laid = np.full(n + (len(begin) + 1) * reach, _END)
    place = at + (line_no[at] + 1) * reach
    laid[place] = grams
    least, step, width = laid, 1, 2 * reach + 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(laid) - width + 1], least[width - step : width - step + len(laid) - width + 1])
    cuts = np.zeros(n, bool)
    cuts[at] = least[place - reach] == grams
    starts = np.flatnonzero(new | cuts)
    sizes = np.diff(np.append(starts, n))
    last = np.append(new[starts[1:]], True)  # of its line
    block = ~new[starts] & ~last
    first = np.concatenate([begin, starts[block]])
    order = np.argsort(first, kind="stable")
    size, line = np.concatenate([length, sizes[block]])[order], (np.arange(len(first)) < len(begin))[order]
    return Units(row[first[order]], first[order], size, line, starts, h, (s, e), per)


def shingles(units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every unit, and their numbers."""
    total = int(units.size.sum())
    at = np.arange(total) - np.repeat(np.cumsum(units.size) - units.size, units.size) + np.repeat(units.first, units.size)
    grams, counts, _ = K.gram_hashes(units.hashes[at], units.size, WORDS, whole_short=True)
    return K.distinct_per_row(grams, counts)


_TOLD = "rid long, did long, th long, lines long, first int, size int, start int, end int, line boolean, n int, cls long, cls2 long, sig binary"


def _describe(hashes: int):
    """One row for each text, and one for each unit; lines that may be linked without being equal have their minhash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, did, th = (batch.column(c).to_numpy() for c in ("rid", "did", "th"))
            for i, j, data, offsets in K.chunks(*K.buffers(batch.column("text"))):
                u = cut(data, offsets)
                values, n = shingles(u)
                cls, cls2 = set_hashes(values, n)
                m, c = j - i, len(n)
                keyed = u.line & (n >= 4)  # smaller sets reach the similarity only if they are equal
                sig = np.full(c, None, object)
                sig[keyed] = [x.tobytes() for x in minima(values[np.repeat(keyed, n)], n[keyed], hashes)]
                row = np.concatenate([np.arange(m), u.row])
                text = np.arange(m + c) < m
                of_unit = lambda x, kind: pa.array(np.concatenate([np.zeros(m, kind), x.astype(kind)]), mask=text)  # noqa: B023, E731
                s, e = u.words
                lines = np.concatenate([np.bincount(u.row[u.line], minlength=m), np.zeros(c, np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[i:j][row]) for x in (rid, did, th)]
                    + [pa.array(lines, mask=~text), of_unit(u.first - (np.cumsum(u.per) - u.per)[u.row], np.int32), of_unit(u.size, np.int32)]
                    + [of_unit(s[u.first] - offsets[u.row], np.int32), of_unit(e[u.first + u.size - 1] - offsets[u.row], np.int32)]
                    + [of_unit(u.line, bool), of_unit(n, np.int32), of_unit(cls, np.int64), of_unit(cls2, np.int64), pa.array([None] * m + sig.tolist(), pa.binary())],
                    _names(_TOLD),
                )

    return run


def _with_keys(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                low = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                keys = band_keys(low.astype(np.uint64), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cls", "n", "sig")), lists], ["cls", "n", "sig", "keys"])

    return run


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


_CONTEXT = "cls long, side int, open boolean, ctx binary, rid long, first int, size int, start int, end int, ends array<int>"
_CUT = "root long, z binary, n_bytes long"


def _flat(column: pa.ListArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Offsets of a list column, and the fields of its structs one list after the other."""
    values = column.flatten()
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], {f.name: values.field(k) for k, f in enumerate(values.type)}


def _from_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every listed text the packed lines that are candidates, and for units that occur again the parts beside them: word hashes from the border
    on; for parts that no such unit covers (open) also where the words end (or start).  Others are only told where they are the last that is
    covered: copies end there, and one whose cut is elsewhere has its like there."""
    codec = pa.Codec("zstd", 1)
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.int64()]
    for batch in batches:
        out: list[tuple] = []
        offsets, of = _flat(batch.column("units"))
        candidate = of["root"].is_valid().to_numpy(zero_copy_only=False)
        first, size, start, end, cls = (of[c].to_numpy() for c in ("first", "size", "start", "end", "cls"))
        root = of["root"].fill_null(0).to_numpy()
        for r, (rid, z, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rid", "z", "n_bytes")), strict=True)):
            own = np.arange(offsets[r], offsets[r + 1])
            text = _unpack(codec, z, n)
            for x in own[candidate[own]].tolist():
                piece = text[start[x] : end[x]]
                out.append((cls[x], *[None] * 9, root[x], codec.compress(piece, asbytes=True), len(piece)))
            own = own[~candidate[own]]
            if not len(own):
                continue
            u = cut(np.frombuffer(text, np.uint8), np.array([0, n]))
            s, e = u.words
            border = np.append(u.starts, len(s))
            steps = np.bincount(first[own], minlength=len(s) + 1) - np.bincount(first[own] + size[own], minlength=len(s) + 1)
            covered = np.concatenate([[False], np.cumsum(steps)[u.starts] > 0, [False]])  # part by part, from 1 on
            for side, part in ((1, np.searchsorted(u.starts, first[own] + size[own])), (-1, np.searchsorted(u.starts, first[own]) - 1)):
                there = (part >= 0) & (part < len(u.starts))
                there[there] &= ~(covered[part[there] + 1] & covered[part[there] + 1 + side])
                for x, b in zip(own[there].tolist(), part[there].tolist(), strict=True):
                    a, w, free = int(border[b]), int(border[b + 1] - border[b]), not covered[b + 1]
                    ends = (e[a : a + w] if side == 1 else s[a : a + w][::-1]) if free else None
                    out.append((cls[x], side, free, u.hashes[a : a + w][::side].tobytes(), rid, a, w, int(s[a]), int(e[a + w - 1]), ends, None, None, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], _names(f"{_CONTEXT}, {_CUT}"))


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ctx, words it shares with a neighbour) of contexts that come in order within (cls, side); those that occur twice share all."""

    def shared(x: bytes, y: bytes) -> int:
        n = min(len(x), len(y)) // 8
        a, b = np.frombuffer(x, np.int64, n), np.frombuffer(y, np.int64, n)
        differ = np.flatnonzero(a != b)
        return int(differ[0]) if len(differ) else n

    def told(rows: list[list]) -> pa.RecordBatch:
        some = [r for r in rows if r[3] and r[4]]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], k) for c, k in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.int32()))], ["cls", "side", "ctx", "k"])

    held: list | None = None
    for batch in batches:
        out: list[list] = []
        for cls, side, ctx, times, free in zip(*(batch.column(c).to_pylist() for c in ("cls", "side", "ctx", "times", "open")), strict=True):
            now = [cls, side, ctx, len(ctx) // 8 if times > 1 else 0, free]
            if held is not None:
                if held[:2] == now[:2]:
                    k = shared(held[2], ctx)
                    held[3], now[3] = max(held[3], k), max(now[3], k)
                out.append(held)
            held = now
        yield told(out)
    if held is not None:
        yield told([held])


_RESULT = "rid long, n_linked long, n_passages long, longest long, n_removed long, removed_bytes long, removed array<array<int>>, components array<long>"


def _judge(passage: int):
    """Stretches and removals of every text from its linked units and rims."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            offsets, of = _flat(batch.column("parts"))
            if not offsets[-1]:
                continue
            doc = np.repeat(np.arange(m), np.diff(offsets))
            first, size, start, end, cls, to = (of[c].to_numpy().astype(np.int64) for c in ("first", "size", "start", "end", "cls", "to"))
            line, gone = (of[c].fill_null(False).to_numpy(zero_copy_only=False) for c in ("line", "gone"))
            root = of["root"].fill_null(0).to_numpy().copy()
            rims = np.flatnonzero(to)
            if len(rims):  # each goes with the unit that it adjoins
                has = np.isin(doc, doc[rims]) & (to == 0)
                begin: dict[tuple, int] = {}
                finish: dict[tuple, int] = {}
                for i in np.flatnonzero(has).tolist():
                    begin[doc[i], first[i], cls[i]] = i
                    finish[doc[i], first[i] + size[i], cls[i]] = i
                gone = gone.copy()
                for i in rims.tolist():
                    x = finish[doc[i], first[i], cls[i]] if to[i] < 0 else begin[doc[i], first[i] + size[i], cls[i]]
                    root[i], gone[i] = root[x], gone[x]
            order = np.lexsort((-size, first, doc))
            doc, first, size, start, end, line, gone, root = (x[order] for x in (doc, first, size, start, end, line, gone, root))

            def runs(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """Groups of adjoining or overlapping parts: where each begins among those kept, its words, and the group of each part."""
                at = (doc[keep] << 32) + first[keep]  # noqa: B023
                until = np.maximum.accumulate(at + size[keep])  # noqa: B023
                new = np.ones(len(at), bool)
                new[1:] = at[1:] > until[:-1]
                where = np.flatnonzero(new)
                return where, until[np.append(where[1:], len(at)) - 1] - at[where], np.cumsum(new) - 1

            where, words, group = runs(np.arange(len(doc)))
            counted = line | (words[group] >= passage)
            own = doc[where]
            longest = np.zeros(m, np.int64)
            np.maximum.at(longest, own, words)
            lost = np.flatnonzero(counted & gone)
            spans, _, _ = runs(lost) if len(lost) else (np.zeros(0, np.int64),) * 3
            from_, until = start[lost[spans]], np.maximum.reduceat(end[lost], spans) if len(lost) else np.zeros(0, np.int64)
            n_removed = np.bincount(doc[lost[spans]], minlength=m)
            pairs = pa.ListArray.from_arrays(pa.array(np.arange(len(spans) + 1, dtype=np.int32) * 2), pa.array(np.stack([from_, until], 1).ravel().astype(np.int32)))
            names = np.unique(np.stack([doc[counted], root[counted]], 1), axis=0)
            upto = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32))
            numbers = [np.bincount(doc[line], minlength=m), np.bincount(own[words >= passage], minlength=m), longest, n_removed, np.bincount(doc[lost[spans]], until - from_, m).astype(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), *map(pa.array, numbers), pa.ListArray.from_arrays(upto(n_removed), pairs), pa.ListArray.from_arrays(upto(np.bincount(names[:, 0], minlength=m)), pa.array(names[:, 1]))],
                _names(_RESULT),
            )

    return run


def find_repeats(docs: DataFrame, scratch: Scratch, percent: int = PERCENT, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, n_paragraphs, n_linked, n_passages, longest, n_removed, removed_bytes, removed, components) of every document.

    n_paragraphs counts the lines with a word, n_linked those of them in a
    component of several; longest is the words of the longest stretch and
    n_passages the number of stretches of ``passage`` words at least.  removed
    lists, in order, the [start, end) byte offsets of what goes (words next to
    one another in one span): lines that aren't their component's first, and
    within passages also blocks and rims.
    components names those that its lines, and in passages its blocks, are in.
    Every line is compared, whatever its length; a rim ends with the part of a
    line that it lies in.

    A null or empty text has no paragraphs; a repeated row is a document of its
    own, so all but one of several equal rows lose their lines; an empty table
    gives no rows; columns other than doc_id and text are not read.
    """
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("doc_id", F.lit(_NULL_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    bands, rows = tuned_bands(percent / 100)
    told = scratch.keep(named.mapInArrow(_describe(bands * rows), _TOLD), "told")  # names the rows: it is never computed again
    units = told.filter("cls is not null").select("rid", "did", "first", "size", "start", "end", "line", "n", "cls", "cls2", "sig")
    place = F.struct("did", "first", "rid")

    # units that occur again
    units, counted = distinct_classes(units, scratch, "counted", F.count(F.lit(1)).alias("times"), only="times > 1")
    slim = units.select("rid", "did", "first", "size", "start", "end", "line", "cls")
    again = scratch.keep(spread_lookup(slim, counted.withColumn("again", F.lit(True)), "cls", "times", slim.count()).filter("again").drop("again"), "again")

    # lines: distinct sets, and candidates by bands
    place = F.struct("did", "first", "rid")
    lines = units.filter("sig is not null").groupBy("cls").agg(F.min(place).alias("head"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    lines = scratch.keep(lines, "lines")
    keyed = lines.select("cls", "n", "sig").mapInArrow(_with_keys(bands, rows), "cls long, n int, sig binary, keys array<long>")
    groups = scratch.keep(candidate_groups(keyed, scratch, agreement(percent / 100, bands * rows), percent, "paragraph", np.uint16), "groups")

    # one pass over the texts for both
    heads = groups.join(lines.select("cls", "head"), F.col("node") == F.col("cls")).select("cls", "root", F.col("head.rid").alias("rid"), F.col("head.first").alias("first"))
    spots = slim.filter("line").join(heads, ["rid", "first", "cls"]).select("rid", "cls", "first", "size", "start", "end", "root")
    listed = again.select("rid", "cls", "first", "size", "start", "end", F.lit(None).cast("long").alias("root")).unionByName(spots)
    per_text = listed.groupBy("rid").agg(F.collect_list(F.struct("cls", "first", "size", "start", "end", "root")).alias("units"))  # of one text
    ids = told.filter("cls is null").select("rid", "did", "th")
    packed = named.select("did", "th", "text").mapInArrow(_pack, "did long, th long, z binary, n_bytes long")
    if not ids.groupBy("did", "th").count().filter("count > 1").isEmpty():
        packed = packed.dropDuplicates(["did", "th"])  # repeated rows have one text
    pieces = packed.join(per_text.join(ids, "rid"), ["did", "th"]).select("rid", "z", "n_bytes", "units")
    pieces = scratch.keep(pieces.mapInArrow(_from_texts, f"{_CONTEXT}, {_CUT}"), "pieces")

    # components of lines, and the first of every component
    found = linked(pieces.filter("root is not null").select("cls", "root", "z", "n_bytes"), scratch, percent, "paragraph")
    near = found.join(lines.select("cls", "head"), F.col("node") == F.col("cls")).select("cls", "root", "head")
    alike = again.groupBy("cls").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("head"))
    named_by = near.join(alike.withColumnsRenamed({"head": "first_alike"}), "cls", "full")
    named_by = named_by.select("cls", F.coalesce("root", "cls").alias("root"), F.coalesce("times", F.lit(1)).cast("long").alias("times"), F.least("head", "first_alike").alias("head"))
    named_by = scratch.keep(named_by, "named")
    firsts = named_by.groupBy("root").agg(F.min("head").alias("h")).select("root", F.col("h.rid").alias("head_rid"), F.col("h.first").alias("head_first"))
    classes = scratch.keep(named_by.select("cls", "times", "root").join(firsts, "root"), "classes")
    scratch.drop("named", "groups", "lines")

    # linked units, and rims
    lone = slim.filter("line").join(classes.filter("times = 1"), "cls").drop("times")
    members = spread_lookup(again, classes.filter("times > 1"), "cls", "times", again.count()).unionByName(lone)
    gone = (F.col("head_rid") != F.col("rid")) | (F.col("head_first") != F.col("first"))
    contexts = pieces.filter("ctx is not null")
    beside = contexts.groupBy("cls", "side", "ctx").agg(F.count(F.lit(1)).alias("times"), F.max("open").alias("open"))
    word = F.substring("ctx", 1, 8)  # contexts that share any word share their first
    dealt = beside.repartition("cls", "side", word).sortWithinPartitions("cls", "side", "ctx")
    common = dealt.mapInArrow(_common, "cls long, side int, ctx binary, k int")
    right = F.col("side") == 1
    upto = F.element_at("ends", F.col("k"))
    rims = contexts.filter("open").join(common, ["cls", "side", "ctx"]).select(
        "rid", F.when(right, F.col("first")).otherwise(F.col("first") + F.col("size") - F.col("k")).alias("first"), F.col("k").alias("size"),
        F.when(right, F.col("start")).otherwise(upto).alias("start"), F.when(right, upto).otherwise(F.col("end")).alias("end"), F.lit(False).alias("line"), "cls",
        F.when(right, -1).otherwise(1).alias("to"),
    )
    return _result(told, members.withColumn("gone", gone), rims, passage)


def _result(told: DataFrame, members: DataFrame, rims: DataFrame, passage: int) -> DataFrame:
    """Columns of find_repeats from linked units and rims; a rim goes with the unit that it adjoins."""
    unit = ["rid", "first", "size", "start", "end", "line", "cls"]
    none = F.lit(None)
    parts = members.select(*unit, "root", "gone", F.lit(0).alias("to")).unionByName(rims.select(*unit, none.cast("long").alias("root"), none.cast("boolean").alias("gone"), "to"))
    per = parts.groupBy("rid").agg(F.collect_list(F.struct("first", "size", "start", "end", "line", "cls", "root", "gone", "to")).alias("parts"))  # of one text
    done = per.mapInArrow(_judge(passage), _RESULT)
    out = told.filter("cls is null").select("rid", "did", "lines").join(done, "rid", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        F.nullif("did", F.lit(_NULL_ID)).alias("doc_id"), F.col("lines").alias("n_paragraphs"), *map(number, ("n_linked", "n_passages", "longest", "n_removed", "removed_bytes")),
        F.coalesce("removed", F.array().cast("array<array<int>>")).alias("removed"), F.coalesce("components", F.array().cast("array<long>")).alias("components"),
    )
