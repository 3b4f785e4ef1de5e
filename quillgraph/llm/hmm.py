"""Hidden Markov language model, trained by Baum-Welch over the whole corpus.

Words emit through classes: the most frequent words (a fixed number) and the
end of a text are classes of their own; each other word belongs to one of
``TAIL`` classes by its last bytes, and is drawn within it by its count, with
a Good-Turing share for one unknown word.  Every pass sums expected counts
per partition and then across partitions.  The scaled forward recursion gives
the exact likelihood of a class sequence; the words within tail classes are
joined with the vocabulary, which is never collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import Scratch

#: Fewest occurrences of a word with its own class: rarer ones tell how likely unknown words are, so they stay in the tail.
OFTEN = 3
#: Tail classes; all classes (an unsigned 16-bit number holds them); the class of the end of a text.
TAIL, CLASSES = 256, 1 << 16
END = TAIL
HEADS = CLASSES - TAIL - 1
_GROUP = 1_000_000


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and tail class of every word, and words per row."""
    low = K.lower_ascii(data)
    s, e, per = K.words(low, offsets)
    tail = K.span_hashes(low, np.maximum(e - 2, s), e, 3) % np.uint64(TAIL)
    return K.span_hashes(low, s, e).view(np.int64), tail.astype(np.int16), per


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, g, n) of a partition's words."""
    have: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, at, back = np.unique(np.concatenate([x[0] for x in have]), return_index=True, return_inverse=True)
        return h, np.concatenate([x[1] for x in have])[at], np.bincount(back, np.concatenate([x[2] for x in have]), len(h)).astype(np.int64)

    for batch in batches:
        for _, _, data, offsets in K.chunks(*K.buffers(batch.column("text")), 4 * K.CHUNK):
            h, g, _ = word_ids(data, offsets)
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            have.append((u, g[at], n))
            held += len(u)
            if held > 3_000_000:
                have = [merged()]
                held = len(have[0][0])
    if have:
        h, g, n = merged()
        for i in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (h, g.astype(np.int32), n)], ["h", "g", "n"])


@dataclass
class Vocabulary:
    """Training counts.  words: (h, g, n) of every word, in the shared folder; heads are sorted hashes with their counts."""

    words: DataFrame
    total: int
    distinct: int
    texts: int
    heads: np.ndarray
    head_counts: np.ndarray
    tail_total: np.ndarray
    unknown: np.ndarray

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.heads & ((1 << 22) - 1)] = True

    def shipped(self) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        return self.heads, self.head_counts, self.texts, self.sieve


def vocabulary(train: DataFrame, scratch: Scratch) -> Vocabulary:
    """Counts over the texts of train; a text's end counts as a token."""
    texts = train.select(F.coalesce("text", F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count_words, "h long, g int, n long").groupBy("h").agg(F.first("g").alias("g"), F.sum("n").alias("n"))
    words = scratch.keep(counted, "words")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = train.count()
    # the count from which words are heads, from a histogram of at most 4,096 bins: a sort by limit would send HEADS rows of every task
    often = words.filter(F.col("n") >= OFTEN).withColumn("bin", F.floor(F.log2(F.col("n").cast("double")) * 64))
    bins = sorted(((r["bin"], r["k"]) for r in often.groupBy("bin").agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    cut, held = 1 << 30, 0
    for at, k in bins:
        held += k
        if held > HEADS:
            break
        cut = at
    top = often.filter(F.col("bin") >= cut).select("h", "g", "n").toPandas().sort_values("h")  # HEADS rows at most
    heads, counts = top["h"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    # tail = all - heads, by class: TAIL rows
    per = words.groupBy("g").agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).toPandas()
    total, once = np.zeros(TAIL), np.zeros(TAIL)
    total[per["g"]], once[per["g"]] = per["n"], per["once"]
    np.subtract.at(total, top["g"], counts)
    np.subtract.at(once, top["g"], counts == 1)
    unknown = (once + 0.5) / (total + 1)
    return Vocabulary(words, int(sums["n"]) + ends, int(sums["v"]) + (ends > 0), ends, heads, counts, total, unknown)


def encode(docs: DataFrame, vocab: Vocabulary, scratch: Scratch) -> DataFrame:
    """Every text as classes: (uid, doc_id, train, classes, n_tokens, n_known, base, tail).

    base: the sum of log10(count + 1) over heads and the end; tail: the
    hashes of the other words, known or not.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocab.shipped())  # HEADS words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, counts, ends, sieve = shipped.value
        gains, known_end = np.log10(counts + 1.0), int(ends > 0)
        for batch in batches:
            for i, j, data, offsets in K.chunks(*K.buffers(batch.column("text")), 4 * K.CHUNK):
                h, g, per = word_ids(data, offsets)
                at = np.zeros(len(h), np.int64)
                some = np.flatnonzero(sieve[h & (len(sieve) - 1)])
                found = np.minimum(np.searchsorted(heads, h[some]), max(len(heads) - 1, 0)) if len(heads) else np.zeros(0, np.int64)
                ok = heads[found] == h[some] if len(heads) else np.zeros(0, bool)
                head = np.zeros(len(h), bool)
                head[some[ok]] = True
                at[some[ok]] = found[ok]
                cls = np.where(head, at + TAIL + 1, g).astype(np.uint16)
                stop = np.cumsum(per)
                seq = np.insert(cls, stop, END)
                row = np.repeat(np.arange(j - i), per)
                gain = np.zeros(len(h))
                gain[head] = gains[at[head]]
                base = np.bincount(row, gain, j - i) + np.log10(ends + 1.0)
                n_known = np.bincount(row[head], minlength=j - i) + known_end
                n_tail = np.bincount(row[~head], minlength=j - i)
                seq_at, tail_at = np.concatenate([[0], np.cumsum(per + 1)]) * 2, np.concatenate([[0], np.cumsum(n_tail)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i), batch.column("train").slice(i, j - i),
                        pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(seq_at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(seq))]),
                        pa.array(per + 1), pa.array(n_known), pa.array(base),
                        pa.ListArray.from_arrays(pa.array(tail_at.astype(np.int32)), pa.array(h[~head])),
                    ],
                    ["doc_id", "train", "classes", "n_tokens", "n_known", "base", "tail"],
                )

    texts = docs.select("doc_id", "train", F.coalesce("text", F.lit("")).alias("text"))
    out = texts.mapInArrow(run, "doc_id long, train boolean, classes binary, n_tokens long, n_known long, base double, tail array<long>")
    return scratch.keep(out.withColumn("uid", F.monotonically_increasing_id()), "encoded")


@dataclass
class Model:
    """start (K), step (K, K) and emit (CLASSES, K: probability of the class in each state)."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def _sequences(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, first positions, classes) of groups of rows, longest first, of about _GROUP tokens."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(np.uint16)
    begin = (offsets - offsets[0]) // 2
    length = np.diff(begin)
    order = np.argsort(-length, kind="stable")
    total = np.cumsum(length[order])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _GROUP, "right")))
        rows = order[i:j]
        yield rows, np.stack([begin[rows], length[rows]]), flat
        i = j


def forward(model: Model, at: np.ndarray, flat: np.ndarray, keep: bool = False):
    """log10 likelihood of each sequence; with keep, also the scaled forward values, scales and classes of every step."""
    begin, length = at
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), "left")
    out = np.zeros(len(begin))
    alphas, scales, classes = [], [], []
    a = np.broadcast_to(model.start, (len(begin), len(model.start)))
    for t in range(steps):
        n = active[t]
        c = flat[begin[:n] + t]
        a = (a[:n] if t == 0 else a[:n] @ model.step) * model.emit[c]
        s = a.sum(1)
        a = a / s[:, None]
        out[:n] += np.log10(s)
        if keep:
            alphas.append(a)
            scales.append(s)
            classes.append(c)
    return (out, alphas, scales, classes) if keep else out


def expect(model: Model, at: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts (start, step, emit) of a group of sequences and its log10 likelihood."""
    out, alphas, scales, classes = forward(model, at, flat, keep=True)
    k = len(model.start)
    step, gammas = np.zeros((k, k)), [None] * len(alphas)
    later, beta = None, np.ones((0, k))
    for t in range(len(alphas) - 1, -1, -1):
        n = len(alphas[t])
        now = np.ones((n, k))
        if later is not None and len(later):
            now[: len(later)] = later @ model.step.T
            step += alphas[t][: len(later)].T @ later
        gammas[t] = alphas[t] * now
        later = model.emit[classes[t]] * now / scales[t][:, None]
    c, g = np.concatenate(classes), np.concatenate(gammas)
    emit = np.stack([np.bincount(c, g[:, s], CLASSES) for s in range(k)], 1)
    return gammas[0].sum(0), step * model.step, emit, float(out.sum())


def _initial(vocab: Vocabulary, states: int) -> Model:
    """Unigram emissions tilted by fixed pseudo-random factors, and states that tend to stay."""
    unigram = np.concatenate([vocab.tail_total + 1, [vocab.texts + 1], vocab.head_counts + 1, np.zeros(HEADS - len(vocab.heads))])
    rng = np.random.default_rng(11)
    emit = unigram[:, None] * np.exp(rng.normal(0, 0.7, (CLASSES, states)))
    emit[END] = unigram[END]
    step = np.full((states, states), 0.04 / states) + 0.96 * np.eye(states)
    return Model(np.full(states, 1.0 / states), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def train(encoded: DataFrame, vocab: Vocabulary, states: int = 8, rounds: int = 3, prior: float = 20.0) -> tuple[Model, list[float]]:
    """Baum-Welch over all training sequences; prior: pseudo-counts of the unigram distribution in each state.

    Returns the model and the log10 likelihood before each round.
    """
    model, told = _initial(vocab, states), []
    unigram = np.concatenate([vocab.tail_total + 1, [vocab.texts + 1], vocab.head_counts + 1, np.zeros(HEADS - len(vocab.heads))])
    unigram /= unigram.sum()
    spark = encoded.sparkSession
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast((model.start, model.step, model.emit))  # fixed size

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            m = Model(*shipped.value)
            k = len(m.start)
            emit, step, start, total, seen = np.zeros((CLASSES, k)), np.zeros((k, k)), np.zeros(k), 0.0, False
            for batch in batches:
                for _, at, flat in _sequences(batch.column("classes")):
                    a, b, c, d = expect(m, at, flat)
                    start, step, emit, total, seen = start + a, step + b, emit + c, total + d, True
            if seen:
                some = np.flatnonzero(emit.any(1))
                keys = np.concatenate([some, [CLASSES], CLASSES + 1 + np.arange(k), [CLASSES + 1 + k]])
                rows = np.concatenate([emit[some], start[None], step, np.full((1, k), total)])
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *[pa.array(rows[:, s].astype(np.float64)) for s in range(k)]], ["c", *[f"s{s}" for s in range(k)]])

        names = [f"s{s}" for s in range(states)]
        counted = encoded.filter("train").select("classes").mapInArrow(run, "c int, " + ", ".join(f"{n} double" for n in names))
        got = counted.groupBy("c").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # CLASSES + states + 2 rows at most
        if not len(got):
            break
        table = np.zeros((CLASSES + states + 2, states))
        table[got["c"].to_numpy()] = got[names].to_numpy()
        emit, start, step = table[:CLASSES], table[CLASSES], table[CLASSES + 1 : CLASSES + 1 + states]
        told.append(float(table[CLASSES + 1 + states, 0]))
        emit = emit + prior * unigram[:, None]
        model = Model((start + 1) / (start + 1).sum(), (step + 1) / (step + 1).sum(1, keepdims=True), emit / emit.sum(0))
        shipped.unpersist()
    return model, told


def score(encoded: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, base_score, score) of every encoded text."""
    sc = encoded.sparkSession.sparkContext
    shipped = sc.broadcast((model.start, model.step, model.emit, np.concatenate([np.log10(vocab.unknown), np.zeros(CLASSES - TAIL)])))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, step, emit, unknown = shipped.value
        m = Model(start, step, emit)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for rows, at, flat in _sequences(batch.column("classes")):
                out[rows] = forward(m, at, flat)
                lost = np.concatenate([[0.0], np.cumsum(unknown[flat])])
                out[rows] += lost[at[0] + at[1]] - lost[at[0]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("uid", "doc_id", "train", "n_tokens", "n_known", "base")], pa.array(out)], ["uid", "doc_id", "train", "n_tokens", "n_known", "base", "model"])

    ahead = encoded.select("uid", "doc_id", "train", "n_tokens", "n_known", "base", "classes").mapInArrow(
        run, "uid long, doc_id long, train boolean, n_tokens long, n_known long, base double, model double"
    )
    # a known tail word: its share of the class instead of the unknown word's
    offsets = [float(x) for x in np.log10(1 - vocab.unknown) - np.log10(np.maximum(vocab.tail_total, 1)) - np.log10(vocab.unknown)]
    gain = F.element_at(F.array(*[F.lit(x) for x in offsets]), F.col("g") + 1) + F.log10("n")
    known = vocab.words.select("h", F.log10(F.col("n") + 1.0).alias("b"), gain.alias("m"))
    found = encoded.select("uid", F.explode("tail").alias("h")).join(known, "h").groupBy("uid").agg(F.sum("b").alias("tb"), F.sum("m").alias("tm"), F.count(F.lit(1)).alias("tk"))
    all_, zero = vocab.total + vocab.distinct + 1, F.lit(0.0)
    return ahead.join(found, "uid", "left").select(
        "doc_id", "train", "n_tokens", (F.col("n_known") + F.coalesce("tk", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("tb", zero) - F.col("n_tokens") * float(np.log10(all_))).alias("base_score"),
        (F.col("model") + F.coalesce("tm", zero)).alias("score"),
    )


def language_model(docs: DataFrame, is_train: Column, scratch: Scratch, states: int = 8, rounds: int = 3) -> tuple[DataFrame, Vocabulary, list[float]]:
    """Scores of all texts by a model of those where is_train holds.

    A null or empty text is its end alone.  Repeated rows count and are
    scored each; without training texts every word is unknown.  Columns other
    than doc_id and text are not read, so they may have any name.
    """
    marked = docs.select("doc_id", "text", F.coalesce(is_train, F.lit(False)).alias("train"))
    vocab = vocabulary(marked.filter("train"), scratch)
    encoded = encode(marked, vocab, scratch)
    model, told = train(encoded, vocab, states, rounds)
    return score(encoded, vocab, model), vocab, told
