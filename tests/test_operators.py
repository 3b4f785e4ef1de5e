"""Operators on small fixtures with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import evaluate as E
from quillgraph.operators import graph as G
from quillgraph.operators import lookup as L
from quillgraph.operators import recommend as C
from quillgraph.operators import resolve as I
from quillgraph.operators import routing as R
from quillgraph.operators import state as S
from quillgraph.sources import analysis, readers, sinks


def rows(df, *keys):
    return sorted(tuple(r[k] for k in keys) for r in df.collect())


@pytest.fixture
def consumed(spark):
    pairs = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "d"), (3, "e"), (3, "f")]
    return spark.createDataFrame([(u, e, True) for u, e in pairs], "user long, event string, is_primary boolean")


def test_collaborative(consumed):
    got = {r["event"]: (r["raw"], r["cf"]) for r in C.collaborative(consumed).filter("user = 1").collect()}
    assert set(got) == {"c", "d", "e", "f"}
    assert got["c"] == (pytest.approx(2 / 3), pytest.approx(1.0)) and got["d"] == (pytest.approx(1 / 5), pytest.approx(0.3))


def test_filters(spark, consumed):
    disliked = spark.createDataFrame([(1, "c")], "user long, event string")
    assert "c" not in {r["event"] for r in C.collaborative(consumed, disliked=disliked).filter("user = 1").collect()}


def test_profiles(spark):
    c = spark.createDataFrame([(1, 1, 5, "2024-05-25", False), (1, 2, 1, "2024-02-25", False)], "user long, event long, clicks long, d string, favorited boolean").withColumn("last_viewed_at", F.col("d").cast("timestamp_ntz"))
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "event long, embedding array<double>")
    p = C.profiles(c, v, F.lit("2024-05-25").cast("timestamp_ntz")).first()["profile"]
    assert p[0] < 0.05 < p[1] and sum(p) == pytest.approx(1)
    assert C.profiles(c.limit(0), v, F.lit("2024-05-25").cast("timestamp_ntz")).count() == 0


def test_story_fallback(spark):
    few = spark.createDataFrame([(1, e, "s", 1.0 - e / 10) for e in range(4)], "user long, event long, story string, score double")
    assert C.one_per_group(few).count() == 4  # one group of ten required: everything stays
    assert C.one_per_group(few, required=1).count() == 1


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "x", 3), (2, "a", 1), (2, "x", 2)], "user long, event string, rank int")
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "z")], "user long, event string")
    got = {r["user"]: r for r in C.ranking_metrics(ranked, truth).collect()}
    assert got[1]["ndcg"] == pytest.approx(1) and got[1]["hit"] == 1 and got[2]["recall"] == 0.5 and got[3]["ndcg"] == 0


def test_holdout(spark):
    h = spark.createDataFrame([(1, e, f"2024-01-{10 - e:02d}", e != 0) for e in range(6)] + [(2, 9, "2024-01-01", True)], "user long, event long, d string, eligible boolean").withColumn("last_viewed_at", F.col("d").cast("timestamp_ntz"))
    assert rows(C.holdout(h).filter("held"), "user", "event") == [(1, 1)]  # the newest eligible; a lone event isn't held out


def test_choose_weight(spark):
    grid = lambda *x: spark.createDataFrame(list(x), "alpha double, ndcg double")
    assert C.choose_weight(grid((0.1, 0.9), (0.7, 0.2)), 0.7).first()["alpha"] == 0.6
    assert C.choose_weight(grid((0.6, 0.5), (0.9, 0.5)), 0.7).first()["alpha"] == 0.6
    assert C.choose_weight(grid((0.1, 0.0), (0.9, 0.0)), 0.65).first()["alpha"] == 0.7
    assert C.choose_weight(grid().limit(0) if False else grid((0.1, 0.0)).limit(0), 0.5).first()["alpha"] == 0.5


def test_conflicts(spark):
    cases = [(["a", "b"], ["c", "d"], [], [], True), (["a"], ["c", "d"], [], [], False), (["a", "b"], ["b", "c"], [], [], False), ([], [], ["t"], ["u"], True), ([], [], ["t"], [], False)]
    df = spark.createDataFrame(cases, "aa array<string>, ab array<string>, ta array<string>, tb array<string>, want boolean")
    assert df.filter(I.definitely_different(F.col("aa"), F.col("ab"), F.col("ta"), F.col("tb")) != F.col("want")).count() == 0


def test_merge_edges(spark):
    t = "src string, type string, dst string, confidence double, is_primary boolean, created_at int"
    old = spark.createDataFrame([("a", "M", "b", 0.4, False, 1)], t)
    new = spark.createDataFrame([("a", "M", "b", 0.9, None, 5), ("a", "M", "b", None, True, 6), ("a", "M", "c", 0.1, None, 7)], t)
    assert rows(G.merge_edges(old, new), "dst", "confidence", "is_primary", "created_at") == [("b", 0.9, True, 1), ("c", 0.1, None, 7)]


def test_paths_are_edge_unique(spark):
    e = spark.createDataFrame([("1", "a", "M", "b", 0.5), ("2", "b", "M", "c", 0.5), ("3", "c", "M", "a", 1.0)], "edge_id string, src string, type string, dst string, confidence double")
    c = spark.createDataFrame([("a",)], "node string")
    got = rows(G.paths(e, c, 3, 10), "node", "hops", "score")
    assert ("b", 1, 0.5) in got and ("b", 2, 0.25) in got and not [x for x in got if x[0] == "a"] and not [x for x in got if x[1] == 3]


def test_components_and_remap(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {r["root"] for r in G.components(e).collect()} == {1, 100}
    m = spark.createDataFrame([("b", "a")], "old string, kept string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert rows(G.remap(edges, m), "src", "dst") == [("a", "c")]
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "old string, kept string")
    assert rows(G.remap(spark.createDataFrame([("n0", "x"), ("n5", "n9"), ("y", "n8")], "src string, dst string"), chain), "src", "dst") == [("n9", "x"), ("y", "n9")]
    with pytest.raises(ValueError):
        G.last_kept(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "old string, kept string"), rounds=4)


def test_lookups(spark):
    a = spark.createDataFrame([(["x"], "y", "t"), (["x"], "x", "t"), (None, "y", "t"), (["x"], "t", "t"), (["x"], None, "t")], "a array<string>, n string, t string")
    assert [r[0] for r in a.select(L.add_alias(F.col("a"), F.col("n"), F.col("t"))).collect()] == [["x", "y"], ["x"], ["y"], ["x"], ["x"]]
    assert [r[0] for r in a.select(L.first_label(F.col("a"), ["x", "z"])).collect()] == ["x", "x", None, "x", "x"]
    c = spark.createDataFrame([("a?>é", 5)], "s string, i long").withColumn("c", L.encode_cursor(F.col("s"), F.col("i")))
    got = c.select("c", L.decode_cursor(F.col("c"), 2).alias("p"), L.decode_cursor(F.col("c"), 3).alias("q"), L.decode_cursor(F.col("c"), 2, 2).alias("r")).first()
    assert got["p"] == ["a?>é", "5"] and got["q"] is None and got["r"] is None and not set(got["c"]) & set("+/=")
    lease = spark.createDataFrame([(1, None, None), (2, "o", 5), (3, "o", 50)], "id long, owner string, lease long")
    assert rows(L.claim(lease, "me", F.lit(10)), "id", "won", "owner") == [(1, True, "me"), (2, True, "me"), (3, False, "o")]
    items = spark.createDataFrame([(1, "a", 1, "k", 0.5), (1, "a", 2, "k", 0.9), (1, "b", 1, "k", 0.1), (1, "c", 3, "?", 0.1), (1, None, 4, "k", 0.1)], "user long, event string, rank int, kind string, score double")
    assert rows(L.valid_items(items, ["k"]), "event", "rank") == [("a", 1)]
    one, none = spark.createDataFrame([(1, 1)], "u long, n long"), spark.createDataFrame([], "u long, n long")
    known = spark.createDataFrame([(1,), (2,)], "n long")
    want = spark.createDataFrame([(1, 2), (1, 2), (1, 9)], "u long, n long")
    assert rows(L.set_difference(one, want, known, ["u", "n"]), "u", "n", "change") == [(1, 1, "REMOVE"), (1, 2, "ADD")]
    assert rows(L.set_difference(none, none, known, ["u", "n"]), "u", "n") == []


def test_entities(spark):
    ents = spark.createDataFrame([("n1", "ORG", "a b", ["AB"]), ("n2", "PERSON", "kim", None), ("n3", None, "seoul", None)], "node_id string, entity_type string, canonical_name string, aliases array<string>")
    ask = spark.createDataFrame([(1, ["x", "AB"], "ORG"), (2, ["kim"], "ORG"), (3, ["seoul"], "LOCATION"), (4, ["none"], "ORG")], "mention long, names array<string>, entity_type string")
    assert rows(I.match_entities(ask, ents).fillna("-", ["node"]), "mention", "node") == [(1, "n1"), (2, "-"), (3, "n3"), (4, "-")]


def test_complete_link_is_not_components(spark):
    p = spark.createDataFrame([(1, 1, 2, 0.9), (1, 2, 3, 0.8)], "g long, a long, b long, score double")
    assert rows(I.complete_link(p, "g", 0.5), "id", "cluster") == [(1, 1), (2, 1), (3, 3)]


def test_dedup_in_order(spark):
    t = "g long, id long, seq long, embedding array<double>, actors array<string>, targets array<string>"
    a = spark.createDataFrame([(1, 1, 1, [1.0, 0.0], ["x", "y"], []), (1, 2, 2, [1.0, 0.05], ["x"], []), (1, 3, 3, [1.0, 0.02], ["p", "q"], []), (1, 4, 4, [0.0, 1.0], [], [])], t)
    assert rows(I.dedup_in_order(a, "g"), "id", "event") == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_stories(spark):
    e = spark.createDataFrame([(1, "T", "2024-01-10", [1.0, 0.0], ["a", "b"], []), (2, "T", "2024-03-10", [1.0, 0.0], [], [])], "event long, topic string, at string, embedding array<double>, actors array<string>, targets array<string>")
    s = spark.createDataFrame([(7, "T", "2024-01-01", [1.0, 0.1])], "story long, topic string, last_at string, embedding array<double>")
    m = spark.createDataFrame([(7, "2024-01-01", ["c", "d"], []), (7, "2023-12-30", ["a"], [])], "story long, assigned_at string, actors array<string>, targets array<string>")
    assert [r["story"] for r in I.assign_stories(e, s, m).collect()] == [7]
    assert I.assign_stories(e, s, m.filter("assigned_at > '2023-12-31'")).count() == 0  # all recent members conflict


def test_evaluation(spark):
    s = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False)], "score double, label boolean")
    assert E.average_precision(s).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert E.roc_auc(s).first()[0] == pytest.approx((1 + 1 + 0.5 + 1) / 4)
    assert E.roc_auc(s.filter("label")).first()[0] is None
    best = E.best_threshold(s, 1.0).first()
    assert best["threshold"] == 0.8 and best["recall"] == 1
    stop = E.early_stop(spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.2), (4, 0.3)], "epoch long, metric double"), 2)
    assert rows(stop, "epoch", "stop") == [(1, False), (2, False), (3, False), (4, True)]
    o = E.pair_order(spark.createDataFrame([(1, 2), (2, 3)], "better long, worse long"), spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.5)], "id long, score double")).first()
    assert (o["pairs"], o["ordered"]) == (2, 1)


def test_routing(spark):
    c = spark.createDataFrame([(1, k, t, s) for k, t, s in ((1, "NEAR", 0.9), (1, "LOCAL", 0.1), (2, "NEAR", 0.8), (3, "NEAR", 0.7), (4, "GLOBAL", 0.9))], "query long, candidate long, tier string, score double")
    assert rows(R.tiered(c, {"LOCAL": 1, "NEAR": 1, "GLOBAL": 0}), "candidate", "tier") == [(1, "LOCAL"), (2, "NEAR")]
    items = spark.createDataFrame([(1, i, "EVENT" if i < 6 else "STATEMENT", 1 - i / 20) for i in range(10)], "article long, id long, kind string, score double")
    got = R.public_selection(items, spark.createDataFrame([(1, 0, 5)], "article long, a long, b long"))
    assert rows(got.filter("slot <> 'TOP'"), "id", "slot") == [(3, "FILL"), (4, "FILL"), (5, "CAUSES")] and got.count() == 9
    r = spark.createDataFrame([(1, k, t, s) for k, t, s in ((1, "a", 9.0), (2, "a", 8.0), (3, "b", 0.1), (1, "b", 0.05))], "query long, candidate long, route string, score double")
    assert [x["candidate"] for x in R.interleave(r, 1, 3).collect()] == [1, 3, 2] or rows(R.interleave(r, 1, 2), "candidate") == [(1,), (3,)]
    assert R.spans(spark.createDataFrame([(1, p) for p in range(4)], "sentence long, pos int"), 2).count() == 7


def test_state(spark):
    t = "article long, status string, attempts int"
    a = spark.createDataFrame([(1, "PROCESSING", 2), (2, "PROCESSING", 0), (3, "COMPLETED", 1)], t)
    o = spark.createDataFrame([(1, "ERROR"), (2, "ERROR"), (3, "ERROR")], "article long, outcome string")
    assert rows(S.analysis_transition(a, o), "article", "status", "attempts") == [(1, "FAILED", 3), (2, "PROCESSING", 1), (3, "COMPLETED", 1)]
    stored = spark.createDataFrame([("e", "old", 1), ("f", "same", 1)], "event string, title string, event_updated_at int")
    new = spark.createDataFrame([("e", "new"), ("f", "same"), ("g", "x")], "event string, title string")
    assert rows(S.titles(stored, new, F.lit(9)), "event", "event_updated_at") == [("e", 9), ("f", 1), ("g", 9)]
    inc = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "user long, aggregated_at int")
    assert rows(S.fresh_only(inc, spark.createDataFrame([(1, 5), (2, 4)], "user long, updated_at int")), "user") == [(2,), (3,)]
    assert rows(S.insert_absent(spark.createDataFrame([("h",)], "k string"), spark.createDataFrame([("h", 1), ("i", 2), ("i", 3)], "k string, v int"), "k", F.col("v")), "v") == [(2,)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿link|title|article|published|company\nhttp://x|t|body|2024|c\n| | |2024|c\n|t2||2024|c\n")
    df = readers.read_psv(spark, str(tmp_path / "a.csv"))
    assert df.count() == 2
    ids = [r[0] for r in df.select(readers.article_id(F.col("link"), F.col("company"), F.col("title"), F.col("published"))).collect()]
    assert len(set(ids)) == 2 and all(len(i) == 40 for i in ids)
    body = '{"articles":[{"title":"T","url":"HTTP://A.B/c#x","content":"z [12 chars]","publishedAt":"2024-05-25T00:00:00Z","source":{"name":"N","url":"https://A.b"}},{"title":" ","url":"u","source":{"name":"N"}}]}'
    got = readers.map_responses(spark.createDataFrame([("world", body), ("general", body)], "category string, body string"))
    first = readers.first_by_category(got).first()
    assert got.count() == 2 and first["category"] == "general" and first["url"] == "http://a.b/c" and first["content_type"] == "TRUNCATED_TEXT" and str(first["published_at"]) == "2024-05-25 09:00:00"
    assert readers.backfill_slices(spark, "2024-01-01", "2024-01-02", 12, 2).count() == 4
    pages = spark.createDataFrame([(1, 1, 10), (1, 2, 3), (1, 3, 0)], "slice_start int, page int, n int")
    assert readers.until_short_page(pages, 10).count() == 2


def test_sinks(spark, tmp_path):
    n = spark.createDataFrame([("1", ["Entity", "Person"])], "id string, labels array<string>")
    e = spark.createDataFrame([("1", "KNOWS", "1")], "src string, type string, dst string")
    assert sinks.write_bundle(n, e, str(tmp_path / "b")).count() == 3 and sinks.load_rows(n).columns == ["id", "labels_json"]
    at = str(tmp_path / "s")
    snap = lambda s, v: spark.createDataFrame([(s, v)], "snapshot_at string, v int")
    assert sinks.replace_snapshot(snap("a", 1), at) and sinks.replace_snapshot(snap("b", 2), at) and sinks.replace_snapshot(snap("a", 3), at)
    assert not sinks.replace_snapshot(snap("b", 0).limit(0), at)
    assert rows(spark.read.parquet(at), "snapshot_at", "v") == [("a", 3), ("b", 2)]


def test_analysis(spark):
    def call(row):
        if row["article_id"] == 2:
            raise TimeoutError
        if row["article_id"] == 3:
            return {"nodes": []}
        return {"classification": {}, "nodes": [{"id": "a", "kind": "EVENT", "name": "n"}, {"id": "t", "kind": "TOKEN"}], "edges": [{"type": "ACTOR", "source": "a", "target": "a"}, {"type": "ACTOR", "source": "a", "target": "t"}, {"type": "X", "source": "a", "target": "a"}]}

    arts = spark.createDataFrame([(1,), (2,), (3,), (4,)], "article_id long")
    got = analysis.analyse(arts, call, spark.createDataFrame([(4,)], "article_id long")).cache()
    assert rows(got.fillna(0), "article_id", "error_code") == [(1, 0), (2, 504), (3, 502)]
    nodes, edges, warnings = analysis.adapt(got)
    assert nodes.count() == 1 and edges.count() == 1 and rows(warnings, "warning") == [("DANGLING_EDGE",), ("EDGE_TYPE",), ("NODE_KIND",)]


def test_streaming(spark, tmp_path):
    from quillgraph.streaming import jobs

    schema = "user long, item long, at timestamp"
    log = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (1, 1, "2024-01-02 00:00:00"), (2, 1, "2024-01-01 00:00:00")], "user long, item long, a string").selectExpr("user", "item", "cast(a as timestamp) at")
    log.write.parquet(str(tmp_path / "in"))
    q = jobs.keep_read_state(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out/batch=0")), "user", "clicks") == [(1, 2), (2, 1)]
