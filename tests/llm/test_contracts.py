"""Queries of the training-data operators against brute force on the smallest documents."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quillgraph.llm import decontamination, paragraphs, queries, tokens
from quillgraph.llm import kernels as K

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs() -> pd.DataFrame:
    return pd.read_parquet(f"{SMALL}/documents.parquet")


def run(spark, name: str) -> pd.DataFrame:
    return queries.queries()[name](spark, SMALL).toPandas()


def shingles(text: str, n: int = 5) -> set:
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


class Roots(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def linked(sets: list[set], percent: int) -> Roots:
    roots, where = Roots(), collections.defaultdict(list)
    for i, s in enumerate(sets):
        common = collections.Counter(j for g in s for j in where[g])
        for j, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                roots.link(i, j)
        for g in s:
            where[g].append(i)
    return roots


def test_op1_catches_labelled_toxic_texts(spark, docs):
    got = run(spark, "op1_toxicity_fm").merge(pd.read_parquet(f"{SMALL}/labels.parquet"), on="doc_id")
    assert len(run(spark, "op1_toxicity_fm")) == len(docs) and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (got.predicted == (got.score >= 0.3)).all() and not (got.predicted & (got.toxic == 0)).any()


def test_op2_equals_brute_force(spark, docs):
    texts = [t.encode() for t in docs.text]
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for row in run(spark, "op2_suffix_array_dedup").itertuples():
        t = texts[docs.index[docs.doc_id == row.doc_id][0]]
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_op3_counts_add_up_to_whole_encodings(spark, docs):
    import tiktoken

    e = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(queries.VOCABULARY), special_tokens={})
    got = run(spark, "op3_token_counts")
    want = docs.set_index("doc_id").text.map(lambda t: len(e.encode_ordinary(t))).sort_index()
    assert (got.groupby("doc_id").n_tokens.sum().sort_index() == want).all()
    assert (got.groupby("doc_id").end.max().sort_index() == docs.set_index("doc_id").text.map(len).sort_index()).all()


def test_op4_equals_brute_force(spark, docs):
    sets = [shingles(t) for t in docs.text]
    roots = linked(sets, 85)
    ids = docs.doc_id.tolist()
    low: dict = {}
    for i, d in enumerate(ids):
        low[roots.find(i)] = min(low.get(roots.find(i), d), d)
    want = {d: (len(sets[i]), low[roots.find(i)], low[roots.find(i)] == d) for i, d in enumerate(ids)}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in run(spark, "op4_minhash_tensored").itertuples()}
    assert got == want


def test_op5_base_is_exact_and_model_is_better(spark, docs):
    words = {d: [*WORD.findall(t.translate(LOWER)), None] for d, t in zip(docs.doc_id, docs.text, strict=True)}
    out = {d for d in words if zlib.crc32(str(d).encode()) % 7 == 2}
    count = collections.Counter(w for d in words if d not in out for w in words[d])
    n, v = sum(count.values()), len(count)
    got = run(spark, "op5_hmm_lm")
    for r in got.itertuples():
        assert r.held_out == (r.doc_id in out) and r.train_tokens == n and r.n_tokens == len(words[r.doc_id])
        assert r.n_known == sum(count[w] > 0 for w in words[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words[r.doc_id]), abs=1e-6)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_op6_equals_full_alignment(spark, docs):
    b = pd.read_parquet(f"{SMALL}/benchmark.parquet")
    items = decontamination.Items.of(b.item_id.tolist(), b.text.tolist())
    begin = items.counts.cumsum() - items.counts
    h, _, _, per = decontamination.word_hashes(*K.buffers(pa.array(docs.text, pa.large_string())))
    at = per.cumsum() - per
    want = set()
    for r in range(len(docs)):
        for t in range(len(b)):
            item = items.words[begin[t] : begin[t] + items.counts[t]]
            s = decontamination.smith_waterman(item, h[at[r] : at[r] + per[r]])[0] / (decontamination.MATCH * len(item))
            if s >= decontamination.THRESHOLD:
                want.add((docs.doc_id[r], b.item_id[t], round(s, 6)))
    assert {(r.doc_id, r.item_id, round(r.score, 6)) for r in run(spark, "op6_decontamination").itertuples()} == want


def test_op7_edits_and_likeness(spark, docs):
    d = docs.sort_values("doc_id", ascending=False).reset_index(drop=True)
    got = run(spark, "op7_oph_fingerprints").sort_values("doc_id", ascending=False).reset_index(drop=True)
    errors = []
    for i, t in enumerate(d.text):
        other, half = d.text[(i + 1) % len(d)], len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        assert got.n_chars[i] == len(t) and got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t.lower()), shingles(edited.lower())
        errors.append(got.near_edited[i] - len(a & b) / max(1, len(a | b)))
    assert abs(sum(errors) / len(errors)) < 0.02 and sum(map(abs, errors)) / len(errors) < 0.05
    assert got.groupby(d.text).fingerprint.nunique().max() == 1


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in os.listdir(SMALL):
        duck.sql(f"create view {table.split('.')[0]} as select * from '{SMALL}/{table}'")
    got, want = run(spark, name), duck.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)


def test_op9_rules_and_verdicts(spark):
    got = run(spark, "op9_url_filter")
    pages = pd.read_parquet(f"{SMALL}/pages.parquet").set_index("page_id").url
    assert len(got) == len(pages) and got.verdict.isin(["allow", "block"]).all()
    for r in got.itertuples():
        rest = pages[r.page_id].split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [(len(x), x, v) for v, x in queries.URL_RULES if ("." + host.lower()).endswith("." + x.split("/", 1)[0]) and path.startswith("/" + x.split("/", 1)[1])]
        assert (r.host, r.path) == (host.lower(), path)
        assert (r.rule, r.verdict) == max(fits)[1:] if fits else pd.isna(r.rule)


def units_of(text: str) -> tuple[list[str], list[tuple[int, int, bool]], list[int]]:
    """Words, (first, size, whole line) of every line and block, and where the parts of lines begin; a cut is where a word's trigram hash is the least within reach on its line."""
    all_words: list[str] = []
    units, parts = [], []
    for line in text.translate(LOWER).split("\n"):
        w = WORD.findall(line)
        if not w:
            continue
        h = paragraphs.cut(*K.buffers(pa.array([line]))).hashes
        grams = K.gram_hashes(h, np.array([len(w)]), 3)[0].tolist()
        cuts = [i for i in range(1, len(grams)) if grams[i] == min(grams[max(0, i - paragraphs.REACH) : i + paragraphs.REACH + 1])]
        at = len(all_words)
        units += [(at, len(w), True), *((at + a, b - a, False) for a, b in zip(cuts, cuts[1:]))]
        parts += [at, *(at + c for c in cuts)]
        all_words += w
    return all_words, units, parts


def test_op10_equals_brute_force(spark, docs):
    """Lines by all pairs, blocks by equality, rims by all pairs of what is beside equal units, stretches word by word."""
    every = []
    words, parts = {}, {}
    for d, t in sorted(zip(docs.doc_id, docs.text, strict=True)):
        words[d], units, parts[d] = units_of(t)
        every += [(d, a, n, line, frozenset(shingles(" ".join(words[d][a : a + n])))) for a, n, line in sorted(units)]
    roots = linked([u[4] if u[3] else set() for u in every], 80)
    same, of_set = collections.Counter(u[4] for u in every), {}
    for i, u in enumerate(every):
        roots.link(of_set.setdefault(u[4], i), i)
    size, head = collections.Counter(), {}
    for i, u in enumerate(every):
        size[roots.find(i)] += 1
        head[roots.find(i)] = min(head.get(roots.find(i), u[:2]), u[:2])
    joined = [size[roots.find(i)] > 1 for i in range(len(every))]
    cover, again = ({d: np.zeros(len(w), bool) for d, w in words.items()} for _ in range(2))
    for i, u in enumerate(every):
        cover[u[0]][u[1] : u[1] + u[2]] |= joined[i]
        again[u[0]][u[1] : u[1] + u[2]] |= same[u[4]] > 1
    rims = collections.defaultdict(list)
    for i, (d, a, n, _, shingle_set) in enumerate(every):
        for side in (1, -1):
            k = parts[d].index(a) - 1 if side < 0 else ([*parts[d], len(words[d])]).index(a + n)
            if same[shingle_set] > 1 and 0 <= k < len(parts[d]):
                if again[d][parts[d][k]] and 0 <= k + side < len(parts[d]) and again[d][parts[d][k + side]]:
                    continue
                x, y = parts[d][k], [*parts[d], len(words[d])][k + 1]
                rims[(shingle_set, side)].append((tuple(words[d][x:y][::side]), d, x, y - x, None if again[d][x] else i))
    got = {r.doc_id: r for r in run(spark, "op10_paragraph_dedup").itertuples()}
    gone = {d: [u[1:4] for i, u in enumerate(every) if u[0] == d and joined[i] and head[roots.find(i)] != u[:2]] for d in words}
    for (_, side), contexts in rims.items():
        for x, d, a, n, i in contexts:
            if i is None:
                continue
            k = max([next((j for j, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y))) for y, e, b, _, _ in contexts if (d, a) != (e, b)], default=0)
            first = a if side == 1 else a + n - k
            cover[d][first : first + k] = True
            if k and head[roots.find(i)] != every[i][:2]:
                gone[d].append((first, k, False))
    for d, w in words.items():
        s = np.flatnonzero(cover[d] & ~np.r_[False, cover[d][:-1]])
        e = np.flatnonzero(cover[d] & ~np.r_[cover[d][1:], False]) + 1
        lost = np.zeros(len(w), bool)
        for a, n, line in gone[d]:
            if line or any(x <= a and a + n <= y and y - x >= paragraphs.PASSAGE for x, y in zip(s, e, strict=True)):
                lost[a : a + n] = True
        text = docs.text[docs.index[docs.doc_id == d][0]].encode()
        kept = "".join(text[a:b].decode() for a, b in zip([0, *[x[1] for x in got[d].removed]], [*[x[0] for x in got[d].removed], len(text)], strict=True))
        assert got[d].longest == max([0, *(e - s)]) and got[d].n_passages == sum(e - s >= paragraphs.PASSAGE)
        assert got[d].n_removed == np.count_nonzero(lost & ~np.r_[False, lost[:-1]]) and WORD.findall(kept.translate(LOWER)) == [x for x, y in zip(w, lost, strict=True) if not y]
        assert got[d].n_linked == sum(joined[i] and u[3] for i, u in enumerate(every) if u[0] == d)


def test_op10_finds_words_that_recur(spark):
    """Documents with a run of 50 words that starts elsewhere too, their own text included, have a passage, few others do; the runs' words are found."""
    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    words = {d: WORD.findall(t.translate(LOWER)) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    times = collections.Counter(hash(tuple(w[i : i + 50])) for w in words.values() for i in range(len(w) - 49))
    longest = {}
    for d, w in words.items():
        run = best = 0
        for i in range(len(w) - 49):
            run = run + 1 if times[hash(tuple(w[i : i + 50]))] > 1 else 0
            best = max(best, run + 49 if run else 0)
        longest[d] = best
    got = {r.doc_id: r for r in queries.op10_paragraph_dedup(spark, sf).toPandas().itertuples()}
    marked = {d for d, n in longest.items() if n}
    assert sum(got[d].n_passages > 0 for d in marked) >= 0.95 * len(marked)
    assert sum(got[d].n_passages == 0 for d in words if d not in marked) >= 0.95 * (len(words) - len(marked))
    assert sum(min(got[d].longest, longest[d]) for d in marked) >= 0.95 * sum(longest[d] for d in marked)


def test_pipeline_stages_by_brute_force(spark, docs):
    """Each stage on its own input: clean rows stay, planted ones go."""
    import corpus_pipeline as P
    from quillgraph.llm.storage import Scratch

    scratch, now = Scratch(spark, "test"), spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        out = scratch.keep(stage(spark, now, SMALL), name)
        seen[name] = (now.toPandas(), out.toPandas())
        now = out
    before, after = seen["near_dedup"]
    sets = [shingles(t) for t in before.text]
    roots = linked(sets, 80)  # the stage's own threshold
    assert len(after) == len({roots.find(i) for i in range(len(sets))})
    before, after = seen["suffix_dedup"]
    assert sorted(before.doc_id) == sorted(after.doc_id) and (after.n_chars == after.text.map(len)).all()
    before, after = seen["decontamination"]
    items = [" ".join(WORD.findall(t)) for t in pd.read_parquet(f"{SMALL}/benchmark.parquet").text]
    whole = before.text.map(lambda t: any(i in " ".join(WORD.findall(t)) for i in items))
    assert set(after.doc_id) <= set(before.doc_id[~whole])
    before, after = seen["mixing"]
    assert after.doc_id.isin(before.doc_id).all() and after.groupby("doc_id").size().max() <= 2
    assert [list(x[1].columns) for x in seen.values()][:4] == [list(docs.columns)] * 4
