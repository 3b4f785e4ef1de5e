"""Leaks are found whatever the corpus size and however often the item leaked."""

from __future__ import annotations

from quillgraph.llm import decontamination
from quillgraph.llm.storage import Scratch

WORDS = [f"item{k}" for k in range(30)]


def test_an_items_own_leaks_do_not_hide_it(spark):
    """3,000 copies without the item's last word make every gram but the last frequent."""
    rows = [(i, " ".join(WORDS[:29])) for i in range(3000)] + [(3000, "other words " * 50), (3001, "before " + " ".join(WORDS[:12] + ["new"] + WORDS[12:25]) + " after")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(WORDS))], "item_id long, text string")
    got = {r["doc_id"]: round(r["score"], 6) for r in decontamination.leaks(docs, bench, Scratch(spark, "leaks")).collect()}
    assert got == {**{i: round(29 / 30, 6) for i in range(3000)}, 3001: round(49 / 60, 6)}
    assert [r["doc_id"] for r in decontamination.clean(docs, bench).collect()] == [3000]


def test_regions_hold_every_alignment():
    """Against counting span by span; and an alignment with as many gaps as its score allows lies in one region."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        words, times = rng.integers(0, 12, rng.integers(1, 80)), np.append(rng.integers(0, 3, 11), 0)
        length = max(1, int(times.sum()))
        span = min(2 * length, len(words))
        want = np.zeros(len(words), bool)
        for i in range(len(words) - span + 1):
            if np.minimum(np.bincount(words[i : i + span], minlength=12), times).sum() >= length / 2:
                want[i : i + span] = True
        got = np.zeros(len(words), bool)
        for a, b in decontamination._regions(words, times, length, 0.5):
            got[a:b] = True
        assert (got | ~want).all() and (want.any() == got.any())
    words, times = np.full(5000, 20), np.append(np.ones(20, np.int64), 0)
    words[4000:4040:2] = np.arange(20)  # a word inserted after each
    (a, b), = decontamination._regions(words, times, 20, 0.5)
    assert a <= 4000 and b >= 4039
