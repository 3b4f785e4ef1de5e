"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import decontamination, fingerprints, graphs, hmm, joins, mixing, nearness, paragraphs, suffixes, tokens, toxicity, urls
from quillgraph.llm import queries as Q
from quillgraph.llm.storage import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, key string, did long, term string"
LONG = " ".join(f"w{i % 5000} x{i}" for i in range(30_000))
PASSAGE = "the quick brown fox number {} jumps over the lazy dog near the river bank while seven wise owls keep watch over every single stone on the far side of the old bridge until the morning comes and the bell rings twice"
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, "one", "en", "b"), (5, "one two three four", "en", "b"), (6, LONG, "en", "b"),
    (7, PASSAGE.format(1), "en", "a"), (7, PASSAGE.format(1), "en", "a"), (8, PASSAGE.format(1), None, "c"), (None, PASSAGE.format(2), "en", "c"), (9, "É\u2028ü 漢字 \U0001f600 İ", "de", None), (10, "a" * 5000, "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, la, s, 0, 9.9, 7, "k", 5, "t") for i, t, la, s in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "edges")


def test_toxicity(spark, odd, none, scratch):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    for docs, told in ((odd, labels), (odd, labels.limit(0)), (none, labels)):
        out = toxicity.score(docs, toxicity.fit(docs, told, scratch))
        assert out.columns[-1] == "score" and out.count() == docs.count() and not out.filter("score is null or score < 0 or score > 1").count()


def test_interactions_are_learned():
    """Neither term is toxic alone, both together are: only pairwise factors can tell."""
    rng = np.random.default_rng(1)
    row, at, y = [], [], []
    for i in range(400):
        a, b = (int(x) for x in rng.random(2) < 0.5)
        row += [i] * (a + b)
        at += [0] * a + [1] * b
        y.append(float(a and b))
    m = toxicity.Machine(np.array([1, 2]), 0.0, np.zeros(2), rng.normal(0, 0.1, (2, 4)))
    toxicity.train(m, np.array(row), np.array(at), np.array(y), steps=400)
    p = m.raw(np.array([0, 1, 2, 2]), np.array([0, 1, 0, 1]), 3)
    assert p[2] > 1 > -1 > max(p[0], p[1])


def test_suffixes(odd, none, scratch):
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffixes.remove_repeats(odd, scratch).collect()}
    size = len(PASSAGE.format(1))
    assert got[(1, 0)] == got[(2, 0)] == 0 and got[(7, size)] == got[(8, size)] == size and got[(10, 5000)] == 5000
    assert suffixes.remove_repeats(odd, scratch).count() == len(ROWS) and suffixes.remove_repeats(none, scratch).count() == 0
    kept = suffixes.remove_repeats(odd, scratch, keep_text=True, carry=["key", "did"], as_text=True)
    assert kept.filter("doc_id = 4").first()["kept"] == "one" and {"key", "did"} <= set(kept.columns)


def test_hot_hashes_are_split(spark, scratch):
    rng = random.Random(3)
    junk = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    core = junk(230)
    docs = spark.createDataFrame([(i, junk(150) + core + junk(150)) for i in range(12)], "doc_id long, text string")
    plain, hot = (sorted(map(tuple, suffixes.remove_repeats(docs, scratch, hot=h).collect())) for h in (10_000, 2))
    assert plain == hot and all(r[2] >= 230 for r in plain)


def test_periodic_text_in_bounded_memory():
    """A text of one long run sorts without copies of its windows."""
    import tracemalloc

    text = b"ab" * 200_000
    tracemalloc.start()
    marked = suffixes.repeated_starts([text])
    assert tracemalloc.get_traced_memory()[1] < 150 * len(text) and marked[: len(text) - 199].all() and not marked[len(text) - 199 :].any()
    tracemalloc.stop()


def test_suffix_array_against_sorting():
    rng = random.Random(5)
    for _ in range(60):
        t = bytes(rng.choice(b"aab\xff") for _ in range(rng.randint(1, 80)))
        order = suffixes.suffix_array(t, 96)
        assert order.tolist() == sorted(range(len(t)), key=lambda p: t[p:])
        got = suffixes.common_prefixes(t, order, 96)
        for k in range(1, len(t)):
            a, b = t[order[k - 1] :], t[order[k] :]
            assert got[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_tokens(odd, none):
    ranks = tokens.read_ranks(Q.VOCABULARY)
    got = tokens.count_by_line(odd, ranks)
    assert {r["doc_id"] for r in got.collect()} == {r[0] for r in ROWS} and got.filter("doc_id = 1").first()["n_tokens"] == 0
    assert tokens.count_by_line(none, ranks).count() == 0
    fields = tokens.count_by_field(odd, ["lang", "text", "source"], ranks)
    assert fields.groupBy("section").count().count() == 3
    with pytest.raises(ValueError):
        tokens.count_by_line(odd, ranks, rule="any")


def test_tokens_of_long_white_space():
    """Runs that the encoder's own search survives come out as it cuts them; longer ones come out at all."""
    import tiktoken

    ranks = tokens.read_ranks(Q.VOCABULARY)
    e = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for text in (" " * 20_000, "a" + " " * 20_000, " " * 20_000 + "b c", "a\n" + "\n" * 15_000 + "b" + " \t" * 9_000 + "  x", "\u3000" * 12_000 + "y", "".join(rng.choice(" \n") for _ in range(30_000)) + "1 2"):
        assert tokens.encode(e, text, tokens.PATTERN) == e.encode_ordinary(text)
    assert e.decode(tokens.encode(e, "x" + " " * 1_000_000 + "y", tokens.PATTERN)) == "x" + " " * 1_000_000 + "y"


def test_vocabularies_of_one_size(spark):
    """Two of equal size in one worker: each counts by its own."""
    one = {bytes([i]): i for i in range(256)} | {b"ab": 256}
    two = {bytes([i]): i for i in range(256)} | {b"cd": 256}
    docs = spark.createDataFrame([(1, "abcdcd")], "doc_id long, text string")
    assert [tokens.count_by_line(docs, r).first()["n_tokens"] for r in (one, two)] == [5, 4]


def test_counts_by_line_token_by_token(spark):
    """Every line's counts against a loop over tokens and characters, for all rules."""
    import tiktoken

    ranks = tokens.read_ranks(Q.VOCABULARY)
    e = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {10**6: "a\n\n\n b \n\n c\u00e9\n"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for rule in tokens.RULES:
        got: dict = {}
        for r in tokens.count_by_line(docs, ranks, rule).collect():
            got.setdefault(r["doc_id"], []).append((r["section"], r["n_tokens"], r["n_crossing"]))
        for d, text in texts.items():
            line_of = []  # of every byte
            for k, line in enumerate(text.splitlines(keepends=True) if False else [x + "\n" for x in text.split("\n")]):
                line_of += [k] * len(line.encode())
            first = [(b & 0xC0) != 0x80 for b in text.encode()]
            n = max(1, len(text.split("\n")) - (text.endswith("\n") and len(text) > 0))
            count, cross, at = [0.0] * n, [0] * n, 0
            for token in e.encode_ordinary(text):
                size = len(e.decode_single_token_bytes(token))
                own = line_of[at : at + size]
                chars = {k: sum(f for f, o in zip(first[at : at + size], own, strict=True) if o == k) for k in own}
                part = chars if sum(chars.values()) else {k: own.count(k) for k in own}
                if len(part) > 1:
                    for k in part:
                        cross[k] += 1
                if rule == "start":
                    count[own[0]] += 1
                elif rule == "majority":
                    count[max(part, key=lambda k: (part[k], -k))] += 1
                else:
                    for k, v in part.items():
                        count[k] += v / sum(part.values())
                at += size
            assert [(k, pytest.approx(count[k]), cross[k]) for k in range(n)] == sorted(got[d])


def test_boundary_rules():
    char_at = np.arange(11)
    ends, cuts = np.array([3, 7, 10]), np.array([0, 4, 9])  # the second token has 1 of 4 characters before the cut, the third 2 of 3
    for rule, want in (("majority", [1, 2, 0]), ("start", [2, 1, 0]), ("fraction", [1.25, 0.75 + 2 / 3, 1 / 3])):
        count, crossing = tokens.attribute(ends, cuts, char_at, rule)
        assert count.tolist() == pytest.approx(want) and count.sum() == pytest.approx(3) and crossing.tolist() == [1, 2, 1]


def test_nearness(odd, none, scratch):
    got = nearness.near_components(odd, scratch)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(ROWS) and by[1]["n_shingles"] == by[3]["n_shingles"] == 0 and by[1]["kept"] and by[4]["n_shingles"] == 1
    assert by[8]["component_id"] == 7 and not by[8]["kept"]
    assert nearness.near_components(none, scratch).count() == 0
    stay = nearness.one_of_each(odd, scratch)
    assert stay.columns == odd.columns and stay.filter("doc_id = 7 or doc_id = 8").count() == 1 and stay.filter("doc_id in (1, 2, 3)").count() == 3


def test_blocks_find_the_same_links(spark, scratch, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    texts = [" ".join(w if rng.random() > 0.012 else f"e{rng.randint(0, 10**6)}" for w in base) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, nearness.near_components(docs, scratch).collect()))
    monkeypatch.setattr(nearness, "BLOCK", 7)
    assert sorted(map(tuple, nearness.near_components(docs, Scratch(spark, "blocks")).collect())) == whole
    assert len({r[2] for r in whole}) > 3  # links within a bucket and texts apart


def test_large_group_of_near_copies(spark, monkeypatch):
    """6,000 near copies and 40 texts that share half with them: rows grow in proportion, and the result is as planted."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    near = [" ".join([*base[:-1], f"n{i}"]) for i in range(6000)]
    half = [" ".join([*base[:70], *(f"h{i}x{rng.random()}" for _ in range(30))]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(near + half)), "doc_id long, text string").repartition(4)
    kept = []
    plain = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: kept.append((name, out := plain(self, df, name))) or out)
    got = {r["doc_id"]: r["component_id"] for r in nearness.near_components(docs, Scratch(spark, "large")).collect()}
    assert got == {**dict.fromkeys(range(6000), 0), **{i: i for i in range(6000, 6040)}}
    rounds = [n for n, _ in kept if "links" in n]
    assert len(rounds) < 40


def test_classes_of_one_hash_are_told_apart(spark, scratch):
    told = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 1), (4, 8, 5), (5, None, None)], "id long, cls long, cls2 long")
    again, classes = nearness.distinct_classes(told, scratch, "clash", F.count(F.lit(1)).alias("times"))
    name = {r["id"]: r["cls"] for r in again.collect()}
    assert name[1] == name[3] != name[2] and name[5] is None and len(set(name.values())) == 4
    assert sorted(r["times"] for r in classes.collect()) == [1, 1, 2]


def test_hot_keys_are_spread(spark, scratch, monkeypatch):
    """A star of 3,000 edges and many nulls: components and lookups as without spreading."""
    monkeypatch.setattr(joins, "ROWS", 50)
    monkeypatch.setattr(joins, "KEYS", 100)
    monkeypatch.setattr(graphs, "ONE_TASK", 0)
    rows = spark.createDataFrame([(i, 5 if i < 900 else None if i < 1000 else i) for i in range(1500)], "id long, key long")
    table = rows.filter("key is not null").groupBy("key").count().withColumn("v", F.col("key") * 2)
    got = {r["id"]: r["v"] for r in joins.spread_lookup(rows, table, "key", "count", 1500).collect()}
    assert got == {i: 10 if i < 900 else None if i < 1000 else 2 * i for i in range(1500)}
    star = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(5000, 5001), (5001, 5002)], "a long, b long")
    assert {r["node"]: r["root"] for r in graphs.components(star, scratch, "star").collect()} == {**dict.fromkeys(range(3000), 0), **dict.fromkeys(range(5000, 5003), 5000)}


def test_language_model(spark, odd, none, scratch):
    scored, vocab, told = hmm.language_model(odd, F.col("doc_id") % 2 == 0, scratch)
    assert scored.count() == len(ROWS) and not scored.filter("score is null or isnan(score)").count() and told == sorted(told)
    assert scored.filter("doc_id = 1").first()["n_tokens"] == 1
    for docs, rule in ((none, F.lit(True)), (odd, F.lit(False))):
        assert hmm.language_model(docs, rule, Scratch(spark, "lm"))[0].count() == docs.count()


def test_forward_is_exact():
    """Against the sum over all state paths."""
    import itertools

    rng = np.random.default_rng(4)
    k, n = 3, 5
    norm = lambda m: m / m.sum(-1, keepdims=True)
    emit = np.zeros((hmm.CLASSES, k))
    emit[:6] = norm(rng.random((k, 6))).T
    m = hmm.Model(norm(rng.random(k)), norm(rng.random((k, k))), emit)
    seq = rng.integers(0, 6, n).astype(np.uint16)
    total = sum(m.start[p[0]] * np.prod([m.step[a, b] for a, b in itertools.pairwise(p)]) * np.prod([emit[c, s] for c, s in zip(seq, p, strict=True)]) for p in itertools.product(range(k), repeat=n))
    at = np.array([[0], [n]])
    assert hmm.forward(m, at, seq)[0] == pytest.approx(np.log10(total))
    start, step, counts, _ = hmm.expect(m, at, seq)
    assert start.sum() == pytest.approx(1) and step.sum() == pytest.approx(n - 1) and counts.sum() == pytest.approx(n)


def test_decontamination(spark, odd, none, scratch):
    bench = spark.createDataFrame([(1, PASSAGE.format(3)), (2, None), (3, ""), (4, "one"), (1, PASSAGE.format(3))], "item_id long, text string")
    got = decontamination.leaks(odd, bench, scratch)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} >= {(7, 1), (8, 1), (None, 1), (4, 4)}
    assert decontamination.leaks(odd, bench.limit(0), scratch).count() == 0 and decontamination.leaks(none, bench, scratch).count() == 0
    kept = decontamination.clean(odd, bench)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 5, 6, 9, 10}
    edited = PASSAGE.format(1).replace("quick brown", "fast red").replace("seven wise owls", "seven old and wise owls")
    docs = spark.createDataFrame([(1, f"Before it all. {edited} After."), (2, LONG)], "doc_id long, text string")
    hit = decontamination.leaks(docs, bench.filter("item_id = 1").limit(1), scratch).collect()
    assert [r["doc_id"] for r in hit] == [1] and 0.7 < hit[0]["score"] < 1


def test_fingerprints(odd, none):
    got = fingerprints.compare_with_edits(odd)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(ROWS) and by[1]["fingerprint"] == "" == by[3]["fingerprint"] and by[7]["fingerprint"] == by[8]["fingerprint"] and len(by[4]["fingerprint"]) == 256
    assert by[1]["near_edited"] == 1 and fingerprints.compare_with_edits(none).count() == 0


@pytest.mark.parametrize("width", [16, 256])
def test_order_of_documents(spark, width):
    ids = [1, 2, 3, 10, 11, 500, 501, 70_000, 10**12, -5, -6]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "tnone")], "doc_id long, t string")
    got = {r["doc_id"]: r["next_t"] for r in fingerprints.with_next(df, ["t"], width).collect()}
    order = [*sorted(ids, reverse=True), None]
    assert got == {a: f"t{b}" if b is not None else "tnone" for a, b in zip(order, [*order[1:], order[0]], strict=True)}


def test_mixing(spark, odd, none):
    got = mixing.mix(odd)
    assert got.count() == len(ROWS) and not got.filter("target is null or copies is null or copies > 2").count() and got.columns.count("size") == 1
    assert mixing.mix(none).count() == 0 and mixing.emit(got).count() == got.agg(F.sum("copies")).first()[0]
    per = mixing.mix(spark.range(4000).selectExpr("id doc_id", "concat_ws(' ', array_repeat('w', 20 + int(id % 50))) text", "concat('s', id % 4) source"))
    for r in per.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect():
        assert abs(r["taken"] - r["target"]) < 0.1 * r["target"]


def test_mixing_of_repeated_rows(spark):
    """Equal rows draw apart, and a rerun over other partitions takes as many."""
    rows = spark.range(300).selectExpr("7L doc_id", "concat_ws(' ', array_repeat('w', 100)) text", "'a' source")
    other = spark.range(300).selectExpr("id + 100 doc_id", "concat_ws(' ', array_repeat('w', 100)) text", "'b' source")
    docs = rows.unionByName(other)
    taken = [{r["source"]: (r["taken"], r["target"]) for r in mixing.mix(d).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()} for d in (docs.repartition(3), docs.repartition(7))]
    assert taken[0] == taken[1] and all(abs(t - want) < 0.12 * want for t, want in taken[0].values())


def test_ranks_of_many_sources(spark, scratch):
    names = [None, "https://a", *(f"https://{i:05d}" for i in range(500)), "é", "z", "\U0001f600"]
    sizes = spark.createDataFrame([(n, 1) for n in names], "source string, source_size long").repartition(5)
    got = {r["source"]: r["weight"] for r in mixing.weighted_sources(sizes, (5, 2, 1), scratch).collect()}
    order = [*sorted(n for n in names if n is not None), None]
    assert got == {n: (5, 2, 1)[i % 3] for i, n in enumerate(order)}


def test_url_models_on_rules_kept_from_them(spark):
    """The models learn from rules of some hosts and judge others, whose good and bad urls differ in their words, also behind a ?."""
    rng = random.Random(3)
    good, bad = ["article", "science", "history", "library"], ["casino", "jackpot", "poker", "xbonus"]
    rows, truth = [], {}
    for i in range(1200):
        words, kind = (good, "allow") if i % 2 else (bad, "block")
        tail = f"{rng.choice(words)}/{rng.choice(words)}{rng.randint(1, 99)}"
        host = ("g.org" if i % 2 else "b.com") if i % 3 else "new.net"
        rows.append((i, f"http://{host}/{tail}" if i % 5 else f"http://{host}/x?{tail}"))
        truth[i] = kind
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), [("allow", "g.org/"), ("block", "b.com/")]).filter("rule is null").collect()
    assert len(got) == 400 and sum(r["verdict"] == truth[r["page_id"]] for r in got) >= 0.95 * len(got)


def test_short_items_are_found_everywhere(spark, scratch):
    docs = spark.createDataFrame([(1, "there is one here"), (2, "One two, three"), (3, "nothing"), (4, "one")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one"), (2, "two three"), (3, "four five six")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["score"], r["start"], r["end"]) for r in decontamination.leaks(docs, bench, scratch).collect()}
    assert got == {(1, 1, 1.0, 9, 12), (2, 1, 1.0, 0, 3), (2, 2, 1.0, 4, 14), (4, 1, 1.0, 0, 3)}
    assert [r["doc_id"] for r in decontamination.clean(docs, bench).collect()] == [1, 2, 3]


@pytest.mark.parametrize("share, least", [(0.05, 0.99), (0.1, 0.97), (0.2, 0.9)])
def test_edited_copies_of_items(spark, scratch, share, least):
    """Of 200 items of 40 words, copies with words replaced, dropped and added at random are found."""
    rng = random.Random(int(share * 100))
    word = lambda: f"v{rng.randint(0, 3000)}"
    items = [[word() for _ in range(40)] for _ in range(200)]

    def edited(w: list[str]) -> list[str]:
        out = []
        for x in w:
            kind = rng.randint(0, 2) if rng.random() < share else 3
            out += {0: [word()], 1: [], 2: [x, word()], 3: [x]}[kind]
        return out

    docs = spark.createDataFrame([(i, " ".join([*(word() for _ in range(100)), *edited(w), *(word() for _ in range(100))])) for i, w in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    hits = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench, scratch).collect()}
    assert sum((i, i) in hits for i in range(200)) >= least * 200 and all(a == b for a, b in hits)


def test_pipeline_stages_keep_columns(spark, odd):
    """Columns with an operator's own names, nulls, empty tables and repeated rows."""
    import corpus_pipeline as P

    names = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "target"]
    docs = odd.select("*", *[F.lit(f"own {c}").alias(c) for c in names])
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert r["score"] == 9.9 and all(r[c] == f"own {c}" for c in names), name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    mixed = P.mix_sources(spark, docs, "")
    assert mixed.count() > 0 and P.mix_sources(spark, docs.limit(0), "").count() == 0


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    from quillgraph.llm import storage

    class Conf(dict):
        pass

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            getConf = staticmethod(lambda: Conf({"spark.master": "spark://host:7077"}))

    with pytest.raises(ValueError):
        storage.shared_dir(Session)


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.ORG"), (5, "http://example.org/es/x?y#z"), (6, "http://x.example.org/en/12"), (7, "x://" + "é" * 3000 + "/p"), (7, "http://b.com/fr/"), (8, "http://evilorg/"), (9, "a://b://c.org/d")]
    df = spark.createDataFrame([(*r, "h", "p", "r", "v", 0.5) for r in rows], "page_id long, url string, host string, path string, rule string, verdict string, score double")
    got = urls.judge(df, Q.URL_RULES)
    by = {r["page_id"]: r for r in got.collect() if r["page_id"] != 7}
    assert got.count() == len(rows) and (by[1]["host"], by[1]["path"]) == ("", "") and by[4]["host"] == "a.org" and by[4]["rule"] is None
    assert by[5]["rule"] == "example.org/es/" and by[6]["rule"] == "example.org/en/1" and by[8]["rule"] is None and by[9]["host"] == "b:"
    assert not got.filter("verdict is null").count() and urls.judge(df.limit(0), Q.URL_RULES).count() == 0


def test_paragraphs(spark, odd, none, scratch):
    line = PASSAGE.format(1)
    docs = spark.createDataFrame([(1, f"{line}\nshort\n{line}"), (2, f"x\n{line.replace('quick', 'swift')}"), (3, None), (4, "short\nshort"), (4, "short\nshort")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_paragraphs"], r["n_linked"], r["n_removed"]) for r in paragraphs.find_repeats(docs, scratch).collect())
    assert got == [(1, 3, 3, 1), (2, 2, 1, 1), (3, 0, 0, 0), (4, 2, 2, 1), (4, 2, 2, 1)]  # the later line of document 1 goes, and every later "short"
    assert paragraphs.find_repeats(odd, Scratch(spark, "p")).count() == len(ROWS) and paragraphs.find_repeats(none, Scratch(spark, "q")).count() == 0
    bands, rows = paragraphs.tuned_bands()
    assert bands * rows <= paragraphs.HASHES and (1 - 0.8**rows) ** bands <= paragraphs.MISS


def test_passages_inside_lines(spark, scratch):
    """A passage of 60 words inside longer lines, over a line feed, and as a whole line: nearly all of its words are found, the first copy stays."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    inside = lambda p: " ".join([*(word() for _ in range(40)), *p, *(word() for _ in range(40))])
    texts = [inside(passage), inside(passage), inside(passage).replace(" ", "\n", 1), inside([]), " ".join(passage)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in paragraphs.find_repeats(docs, scratch).collect()}
    for d in (0, 1, 2, 4):
        assert 45 <= got[d]["longest"] <= 60
    assert got[0]["n_removed"] == 0 and got[3]["longest"] == 0
    for d in (1, 2, 4):
        (a, b), = got[d]["removed"]
        assert " ".join(texts[d].encode()[a:b].decode().split()) in " ".join(passage)
