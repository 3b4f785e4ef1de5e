"""Thresholds of the pipeline's stages."""

from __future__ import annotations

import random

import corpus_pipeline as P
from quillgraph.llm import nearness

from test_contracts import SMALL, docs, linked, shingles  # noqa: F401


def test_near_copies_from_four_fifths(spark):
    """200 pairs of a similarity of exactly 0.8 (80 of 100 shingles), and 50 of 79 of 99."""
    rng = random.Random(8)
    rows = []
    for k in range(250):
        words = [f"k{k}w{rng.randint(0, 10**6)}" for _ in range(94 if k < 200 else 93)]
        other = [f"e{k}" if i in (20, 60) else w for i, w in enumerate(words)]
        rows += [(2 * k, " ".join(words), "en", "a", 0), (2 * k + 1, " ".join(other), "en", "a", 0)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stay = {r["doc_id"] for r in P.drop_near_copies(spark, made, SMALL).collect()}
    assert stay == {2 * k for k in range(250)} | {2 * k + 1 for k in range(200, 250)}


def test_near_stage_equals_brute_force(spark, docs):  # noqa: F811
    sets = [shingles(t) for t in docs.text]
    roots = linked(sets, 80)
    blank = sum(not s for s in sets)
    stay = P.drop_near_copies(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    assert stay.count() == len({roots.find(i) for i, s in enumerate(sets) if s}) + blank


def test_sizes_follow_the_threshold():
    assert [(nearness.tensor_size(p), nearness.agreement(p)) for p in (80, 85)] == [(11, 41), (8, 32)]
