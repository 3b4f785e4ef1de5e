"""Benchmark decontamination: shared n-grams, then Smith-Waterman alignment.

Test items come in blocks of bounded size.  A text and an item that share any
n-gram are a candidate, whatever the size of the corpus and however often the
item leaked; an item shorter than the n-gram is looked up as a whole at every
place.  Only parts of the text that are dense enough in the item's words
to hold an alignment at the threshold are aligned with it, word by word, so
edited copies are scored too and nothing that could score is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import Scratch

#: Words of a seed; bytes of test items in a block.
SEED, BLOCK_BYTES = 3, 4_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Part of the best score that an item could have from which a document is contaminated.
THRESHOLD = 0.5
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end of every run of letters and digits (A-Z lower-cased), and runs per row."""
    low = K.lower_ascii(data)
    s, e, per = K.runs(_WORD[low], offsets)
    return K.span_hashes(low, s, e).view(np.int64), s, e, per


@dataclass
class Items:
    """A block of test items: ids, and their words' hashes one item after the other."""

    ids: list[int | None]
    words: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str | None]) -> Items:
        h, _, _, per = word_hashes(*K.buffers(pa.array(texts, pa.large_string())))
        return cls(ids, h, per)

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of all grams with their item, each pair once; an item shorter than a seed has its whole."""
        grams, per, _ = K.gram_hashes(self.words.view(np.uint64), self.counts, SEED, whole_short=True)
        item = np.repeat(np.arange(len(self.ids)), per)
        order = np.lexsort((item, grams))
        grams, item = grams[order], item[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (item[1:] != item[:-1])
        return grams[new], item[new]


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(best local score, end in a, end in b) of two word sequences, linear gaps."""
    best, end_a, end_b = 0, 0, 0
    row = np.zeros(len(b) + 1, np.int64)
    step = np.arange(len(b) + 1) * -GAP
    for i in range(len(a)):
        new = np.zeros(len(b) + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(b == a[i], MATCH, MISMATCH), 0)
        new = np.maximum(new, row + GAP)
        row = np.maximum.accumulate(new + step) - step
        j = int(row.argmax())
        if row[j] > best:
            best, end_a, end_b = int(row[j]), i + 1, j
    return best, end_a, end_b


def align(item: np.ndarray, text: np.ndarray, regions: list[tuple[int, int]], threshold: float) -> tuple[float, int, int] | None:
    """(score as a part of the item's best possible, first word, end word in text) of the best alignment in the regions, if it is at the threshold."""
    score, a, ea, eb = max(((s, a, i, j) for a, b in regions for s, i, j in (smith_waterman(item, text[a:b]),)), key=lambda x: (x[0], -x[1]))
    if score / (MATCH * len(item)) < threshold:
        return None
    _, _, back = smith_waterman(item[:ea][::-1], text[a : a + eb][::-1]) if score else (0, 0, 0)
    return score / (MATCH * len(item)), a + eb - back, a + eb


def _regions(words: np.ndarray, times: np.ndarray, length: int, threshold: float) -> list[tuple[int, int]]:
    """Parts of a text that hold every alignment at the threshold with an item of ``length`` words, of which word w has times[w].

    Such an alignment matches threshold * length words at least, and its gaps
    cost less than its matches bring, so it spans a bounded part of the text;
    a word counts there as often as the item has it at most.
    """
    span = min(length + int(np.ceil(MATCH * length * (1 - threshold) / -GAP)), len(words))
    own = np.flatnonzero(times[words])
    order = own[np.argsort(words[own], kind="stable")]
    w = words[order]
    k = np.arange(len(order)) - times[w]  # where the last one stands that makes this one too many
    before = np.where((k >= 0) & (w[np.maximum(k, 0)] == w), order[np.maximum(k, 0)], -1)
    start = np.maximum(np.maximum(before, order - span) + 1, 0)  # it counts in the spans that begin from here to its own place
    acc = np.cumsum(np.bincount(start, minlength=len(words) + 1) - np.bincount(order + 1, minlength=len(words) + 1))
    dense = np.flatnonzero(acc[: len(words) - span + 1] >= threshold * length - 1e-9)
    if not len(dense):
        return []
    cuts = np.flatnonzero(np.diff(dense) > span) + 1
    return [(int(g[0]), int(g[-1]) + span) for g in np.split(dense, cuts)]


def text_grams(h: np.ndarray, per: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every gram of SEED words, of texts shorter than that, and of the given smaller sizes."""
    grams, each, _ = K.gram_hashes(h.view(np.uint64), per, SEED, whole_short=True)
    rows, out = [np.repeat(np.arange(len(per)), each)], [grams]
    for n in sizes:
        grams, each, _ = K.gram_hashes(h.view(np.uint64), per, n)
        rows.append(np.repeat(np.arange(len(per)), each))
        out.append(grams)
    row, gram = np.concatenate(rows), np.concatenate(out)
    order = np.argsort(row, kind="stable") if sizes else slice(None)
    return row[order], gram[order]


def _scan(docs: DataFrame, items: Items, threshold: float, drop: bool = False) -> DataFrame:
    """The leaks of a block of items, or with drop the rows of docs without any.

    With drop an item of fewer words than a seed only counts where it is all of a text's words: it occurs in ordinary prose.
    """
    small = [] if drop else sorted({int(c) for c in items.counts if 0 < c < SEED})
    vocabulary, spelt = np.unique(items.words, return_inverse=True)
    shipped = docs.sparkSession.sparkContext.broadcast((items, vocabulary, spelt, *items.seeds()))  # one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, vocabulary, spelt, seeds, seed_item = shipped.value
        begin = np.cumsum(items.counts) - items.counts
        times = np.zeros(len(vocabulary) + 1, np.int64)  # the last stands for all words that no item has
        sieve = np.zeros(1 << 20, bool)
        sieve[seeds & np.uint64((1 << 20) - 1)] = True
        for batch in batches:
            ids, found, clean = batch.column("doc_id"), [], np.ones(batch.num_rows, bool)
            for i, _, data, offsets in K.chunks(*K.buffers(batch.column("text"))):
                h, s, e, per = word_hashes(data, offsets)
                first = np.cumsum(per) - per
                row, grams = text_grams(h, per, small)
                some = np.flatnonzero(sieve[grams & np.uint64((1 << 20) - 1)]) if len(seeds) else np.zeros(0, np.int64)
                lo, hi = np.searchsorted(seeds, grams[some], "left"), np.searchsorted(seeds, grams[some], "right")
                some, lo, hi = some[hi > lo], lo[hi > lo], hi[hi > lo]
                for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(row[some])) + 1) if len(some) else ():
                    r = int(row[some[part[0]]])
                    text = h[first[r] : first[r] + per[r]]
                    at = np.minimum(np.searchsorted(vocabulary, text), len(vocabulary) - 1)
                    at[vocabulary[at] != text] = len(vocabulary)
                    met = {*zip(lo[part].tolist(), hi[part].tolist(), strict=True)}
                    for t in np.unique(np.concatenate([seed_item[x:y] for x, y in met])).tolist():
                        words = slice(begin[t], begin[t] + items.counts[t])
                        np.add.at(times, spelt[words], 1)
                        regions = _regions(at, times, int(items.counts[t]), threshold)
                        times[spelt[words]] = 0
                        got = align(items.words[words], text, regions, threshold) if regions else None
                        if not got:
                            continue
                        a, b = first[r] + got[1], first[r] + got[2]
                        span = [int(((data[offsets[r] : p] & 0xC0) != 0x80).sum()) for p in (s[a], e[b - 1])]
                        clean[i + r] = False
                        found.append((ids[i + r].as_py(), items.ids[t], got[0], *span))
            if drop:
                yield batch.filter(pa.array(clean))
            elif found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "start", "end"])

    return docs.mapInArrow(run, docs.schema if drop else "doc_id long, item_id long, score double, start long, end long")


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Items with a text, in blocks of about BLOCK_BYTES."""
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for row in benchmark.filter("text <> ''").select("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
        if size > BLOCK_BYTES:
            yield Items.of(ids, texts)
            ids, texts, size = [], [], 0
    yield Items.of(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, start, end): the best alignment of each test item with each document that holds it.

    score is the alignment's score as a part of the item's best possible;
    start and end are character offsets.  An item of fewer words than a seed
    is found wherever its words are.  Null or empty texts and items hold
    nothing; repeated rows of either table give repeated results; empty
    tables give none.  Other columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = None
    for k, items in enumerate(_blocks(benchmark)):
        if out is not None and not items.ids:
            break
        part = _scan(docs, items, threshold)
        out = part if out is None else scratch.keep(out, f"leaks-{k}").unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no test item, all columns as they are.

    An item of fewer words than a seed is in most prose, so it only counts for
    a text that has no other words.  Null and empty texts stay, and so does
    everything without items; repeated rows are judged alike; other columns,
    whatever their names, pass through.
    """
    for items in _blocks(benchmark):
        if items.ids:
            docs = _scan(docs, items, threshold, drop=True)
    return docs
