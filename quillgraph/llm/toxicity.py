"""Toxicity: a factorization machine over hashed terms.

Terms are words (runs of letters, A-Z lower-cased) and their first 4, 5 and 6
bytes, as 64-bit hashes.  The machine's pairwise factors let a term count for
more beside another (an insult beside a mention) than alone.  It is fitted on
a bounded sample of labelled rows; scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .storage import Scratch

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
PREFIXES = (4, 5, 6)
#: Least likelihood-ratio statistic (chi-square, one degree of freedom) of a term; below it, classes and term are taken to be independent (p > 0.0005).
TELLING = 12.0


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term hash) of every term occurrence."""
    low = K.lower_ascii(data)
    s, e, per = K.runs(_LETTER[low], offsets)
    row = np.repeat(np.arange(len(per)), per)
    out, rows = [K.span_hashes(low, s, e, 1)], [row]
    for n in PREFIXES:
        long = e - s > n
        out.append(K.span_hashes(low, s[long], s[long] + n, n * 7919))
        rows.append(row[long])
    return np.concatenate(rows), np.concatenate(out).view(np.int64)


def distinct_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term hash), each once per row."""
    row, term = terms(data, offsets)
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    return row[keep], term[keep]


@dataclass
class Machine:
    """Chosen terms (sorted hashes) with bias, linear weights and factors."""

    terms: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.terms & ((1 << 20) - 1)] = True

    def hits(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index of the term) of those terms that the machine knows, each once per row."""
        if not len(self.terms) or not len(row):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = self.sieve[term & ((1 << 20) - 1)]
        row, term = row[some], term[some]
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[at] == term
        key = np.unique(row[known] * len(self.terms) + at[known])
        return key // len(self.terms), key % len(self.terms)

    def raw(self, row: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
        """Bias + sum of weights + sum over pairs of factor products, for every row."""
        out = self.bias + np.bincount(row, self.linear[at], rows)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            out += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return out


def train(machine: Machine, row: np.ndarray, at: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 2e-4) -> Machine:
    """Full-batch Adam on the mean logistic loss; deterministic.  row ascends.

    With s = a text's sum of factors, its pairs give (s^2 - sum of v^2) / 2, and
    their slope by v is s - v; both need one gather and one sum a factor, by
    text and by term.
    """
    n, m, k = len(y), *machine.factors.shape
    turned = np.argsort(at, kind="stable")
    row_of = row[turned]
    by_row, by_term = _Sums(row, n), _Sums(at[turned], m)
    theta = np.concatenate([[machine.bias], machine.linear, machine.factors.T.ravel()])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        linear, factors = theta[1 : m + 1], theta[m + 1 :].reshape(k, m)
        sums = [by_row(f.take(at)) for f in factors]
        raw = theta[0] + by_row((linear - 0.5 * (factors**2).sum(0)).take(at)) + 0.5 * sum(s * s for s in sums)
        p = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
        g = (p - y) / max(n, 1)
        slope = by_term(g.take(row_of))
        grad = np.concatenate([[g.sum()], slope, *(by_term((g * s).take(row_of)) - slope * f for s, f in zip(sums, factors, strict=True))])
        grad[1:] += decay * theta[1:]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    machine.bias, machine.linear, machine.factors = float(theta[0]), theta[1 : m + 1], np.ascontiguousarray(theta[m + 1 :].reshape(k, m).T)
    return machine


class _Sums:
    """Sums of values by ascending keys from 0 to n - 1; 0 for keys without values."""

    def __init__(self, keys: np.ndarray, n: int) -> None:
        self.starts = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys, self.n = keys[self.starts], n

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.starts):
            out[self.keys] = np.add.reduceat(values, self.starts)
        return out


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of a partition with the numbers of toxic and other texts that have them."""
    have: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, back = np.unique(np.concatenate([x[0] for x in have]), return_inverse=True)
        return t, np.bincount(back, np.concatenate([x[1] for x in have]), len(t)), np.bincount(back, np.concatenate([x[2] for x in have]), len(t))

    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.float64)
        for i, _, data, offsets in K.chunks(*K.buffers(batch.column("text"))):
            row, term = distinct_terms(data, offsets)
            bad = toxic[i + row]
            have.append((term, bad, 1 - bad))
            held += len(term)
            if held > 4_000_000:
                have = [merged()]
                held = len(have[0][0])
    if have:
        t, pos, neg = merged()
        for i in range(0, len(t), 100_000):
            j = i + 100_000
            yield pa.RecordBatch.from_arrays([pa.array(t[i:j]), pa.array(pos[i:j].astype(np.int64)), pa.array(neg[i:j].astype(np.int64))], ["term", "pos", "neg"])


def labelled_sample(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_labelled: int) -> DataFrame:
    """Distinct (text, toxic) of about max_labelled labelled documents at most, chosen by a hash of doc_id."""
    ids = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    n = ids.count()
    if n > max_labelled:
        ids = ids.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 32)) < int(max_labelled / n * (1 << 32)))
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # max_labelled rows at most
    return scratch.keep(chosen.groupBy("text").agg(F.max("toxic").alias("toxic")), "sample")


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_labelled: int = 30_000, rank: int = 6) -> Machine:
    """Machine from the labelled documents among docs.

    max_labelled bounds the sample, and so its terms, of which all with a
    likelihood-ratio statistic of TELLING and more are used.  Copies of a text count once; if their
    labels differ, it is toxic.  Without labels of both kinds the machine has
    no terms and scores everything by the prior.
    """
    sample = labelled_sample(docs, labels, scratch, max_labelled)
    total = sample.agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = float(total["p"] or 0), float(total["n"] - (total["p"] or 0))
    prior = float(np.log((pos + 0.5) / (neg + 0.5)))
    empty = Machine(np.zeros(0, np.int64), prior, np.zeros(0), np.zeros((0, rank)))
    if not pos or not neg:
        return empty
    counted = sample.mapInArrow(_count_terms, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    def part(x, n):  # x log(x / expected), 0 for 0
        return F.when(x > 0, x * F.log(x / ((F.col("pos") + F.col("neg")) * n / (pos + neg)))).otherwise(0.0)

    best = counted.filter(2 * (part(F.col("pos"), pos) + part(F.col("neg"), neg)) >= TELLING).collect()  # terms of max_labelled texts
    if not best:
        return empty
    best.sort(key=lambda r: r["term"])
    odds = np.array([np.log((r["pos"] + 0.5) / (pos + 1) / ((r["neg"] + 0.5) / (neg + 1))) for r in best])
    rng = np.random.default_rng(7)
    machine = Machine(np.array([r["term"] for r in best], np.int64), prior, 0.2 * odds, rng.normal(0, 0.01, (len(best), rank)))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list[list[int]] = []
            for i, j, data, offsets in K.chunks(*K.buffers(batch.column("text"))):
                row, at = machine.hits(*terms(data, offsets))
                lists += [x.tolist() for x in np.split(at, np.cumsum(np.bincount(row, minlength=j - i))[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(lists, pa.list_(pa.int32()))], ["toxic", "at"])

    rows = sample.mapInArrow(known, "toxic double, at array<int>").collect()  # max_labelled rows of known terms
    rows.sort(key=lambda r: (r["toxic"], r["at"]))
    per = np.array([len(r["at"]) for r in rows])
    at = np.array([x for r in rows for x in r["at"]], np.int64)
    return train(machine, np.repeat(np.arange(len(rows)), per), at, np.array([r["toxic"] for r in rows]))


def score(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """docs with a score (0 to 1; the higher, the likelier toxic) of the given name.

    A null or empty text has the score of no known term.  A column of that
    name is replaced; all others pass through.
    """
    docs = docs.drop(*[c for c in docs.columns if c == name])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, offsets in K.chunks(*K.buffers(batch.column("text"))):
                out[i:j] = machine.raw(*machine.hits(*terms(data, offsets)), j - i)
            p = 1 / (1 + np.exp(-np.clip(out, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
