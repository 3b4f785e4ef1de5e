"""Golden values of the column functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import scores as S
from quillgraph.functions import temporal as D
from quillgraph.functions import text as X
from quillgraph.functions import vectors as V


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "noise"), [("그", True), ("그는", True), (None, True), ("", True), ("...", True), ("이들 기업", True), ("해당 국가들", True), ("“민주당”", False), ("삼성전자", False), ("그룹", False), ("NATO", False)])
def test_noise_names(spark, name, noise):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(X.is_noise_name(F.col("n")).alias("x")).first()["x"] is noise


def test_entity_name(spark):
    assert one(spark, X.entity_name(F.col("n")), n="  “ＮＡＴＯ   Force” ") == "nato force"


def test_clean_lines(spark):
    text = "정부는 오늘 새로운 정책을 발표했다.\n짧다.\n문의는 a@b.com 으로 보내 주십시오.\n△최영상 기자가 현장에서 전했습니다 😀.\n정부는 오늘 새로운 정책을 발표했다.\n끝나지 않은 문장의 예시입니다"
    assert one(spark, X.clean_lines(F.col("t")), t=text) == "정부는 오늘 새로운 정책을 발표했다.\n최영상 기자가 현장에서 전했습니다."


def test_clean_body(spark):
    body = ["경제", "제목이다", *[f"본문 문장 {i} 입니다. 내용이 이어집니다." for i in range(6)], "", "저작권자 ⓒ 무단 전재"]
    got = one(spark, X.clean_body(F.col("c"), F.col("t")), c="\n".join(body), t="제목이다")
    assert got == "\n".join(body[2:8])
    assert one(spark, X.clean_body(F.col("c"), F.col("t")), c=got, t="제목이다") == got
    cut = "가나다라마바사 아자차카타파하 첫 줄입니다.\n둘째 줄입니다.\n■ 제보하기\n전화 번호"
    assert one(spark, X.clean_body(F.col("c"), F.col("t")), c=cut, t="x") == "\n".join(cut.split("\n")[:2])
    mostly = "AD\n" * 3 + "경제\n공유하기\n짧다"
    assert one(spark, X.clean_body(F.col("c"), F.col("t")), c=mostly, t="x") in (mostly, "짧다")


def test_title_repair(spark):
    c = "경제\n정부, 새 정책 발표\n본문입니다."
    args = dict(t="KBS 뉴스", o="news.kbs.co.kr", d="news.kbs.co.kr", c=c)
    cols = (F.col("t"), F.col("o"), F.col("d"), F.col("c"))
    assert one(spark, X.repair_title(*cols), **args) == "정부, 새 정책 발표"
    assert one(spark, X.repair_title(*cols), **args | {"t": "다른 제목"}) == "다른 제목"
    assert one(spark, X.repair_title(*cols), **args | {"c": "홍길동 기자 = 서울"}) == "KBS 뉴스"


def test_eligible(spark):
    long = "가" * 200
    for title, content, want in (("소식", long, True), ("[부고] 홍길동", long, False), ("오늘의 운세 7월", long, False), ("소식", long[:-1], False), ("소식", None, False)):
        df = spark.createDataFrame([(title, content)], "t string, c string")
        assert df.select(X.eligible(F.col("t"), F.col("c")).alias("x")).first()["x"] is want


@pytest.mark.parametrize(("url", "want"), [("HTTPS://News.Example.COM:8080/A?utm_source=x&b=2#top", "https://news.example.com:8080/A?b=2"), (" not a url ", "not a url"), ("http://a.b/c?fbclid=1", "http://a.b/c"), ("http://a.b?x=1&GCLID=2", "http://a.b?x=1")])
def test_urls(spark, url, want):
    assert one(spark, X.normalise_url(F.col("u")), u=url) == want


def test_search_query():
    phrase, tokens, mark = X.search_query("대통령의  발표는 했다!")
    assert (phrase, tokens) == ("대통령의 발표는 했다!", ["대통령", "발표", "했다"]) and len(mark) == 64
    for bad in ("!!!", " ", " ".join(f"w{i}x" for i in range(21)), "a" * 51):
        with pytest.raises(ValueError):
            X.search_query(bad)


def test_sentences_and_previews(spark):
    assert one(spark, X.whole_sentences(F.col("t")), t="첫 문장이다.  둘째는 끝나지 않는") == "첫 문장이다."
    assert one(spark, X.whole_sentences(F.col("t")), t="끝이 없다 정말") is None
    assert one(spark, X.preview(F.col("t")), t="a" * 121) == "a" * 120 + "…"
    assert one(spark, X.object_particle(F.col("t")), t="책") == "을" and one(spark, X.object_particle(F.col("t")), t="사과") == "를"


def test_vectors_and_scores(spark):
    v = [F.array(F.lit(3.0), F.lit(4.0)).alias("a"), F.array(F.lit(0.0), F.lit(0.0)).alias("b")]
    row = spark.range(1).select(*v).select(V.cosine(F.col("a"), F.col("b")).alias("zero"), V.cosine(F.col("a"), F.col("a")).alias("same"), V.unit(F.col("a")).alias("u"), V.unit(F.col("b")).alias("n")).first()
    assert row["zero"] == 0 and row["same"] == pytest.approx(1) and row["u"] == [0.6, 0.8] and row["n"] == [0, 0]
    assert one(spark, S.half_life(F.lit(14.0), 14.0)) == pytest.approx(0.5)
    assert one(spark, S.percent(F.lit(1), F.lit(3))) == 33.3 and one(spark, S.percent(F.lit(1), F.lit(0))) == 0
    assert one(spark, S.hub_damping(F.lit(10), 40.0)) == 1


def test_times(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    text = lambda c: c.cast("string")
    assert one(spark, D.cycle(ts("2024-05-25 11:59:59"))) == "AM"
    assert one(spark, text(D.cycle_available(ts("2024-05-25 12:00:00")))) == "2024-05-25 18:00:00"
    assert one(spark, text(D.latest_slot(ts("2024-05-25 04:59:00")))) == "2024-05-24 17:00:00"
    assert one(spark, text(D.next_hour(ts("2024-05-25 05:00:00")))) == "2024-05-25 06:00:00"
    assert one(spark, text(D.parse_mixed(F.lit("2024-05-25T09:00:00")))) == "2024-05-25 00:00:00"
    assert one(spark, text(D.parse_mixed(F.lit("2024-05-25T09:00:00Z")))) == "2024-05-25 09:00:00"
    with pytest.raises(ValueError):
        D.day_range("2024-01-02", None)


@pytest.mark.parametrize(("said", "value", "status"), [("2024년 3월 5일", "2024-03-05", "RESOLVED"), ("2024년 2월 30일", None, "UNRESOLVED"), ("어제", "2024-05-24", "RESOLVED"), ("지난해 12월", "2023-12", "RESOLVED"), ("이듬해 3월", "2025-03", "RESOLVED"), ("오는 3일", "2024-06-03", "RESOLVED"), ("3시간 동안", None, "UNRESOLVED"), ("매주", None, "UNRESOLVED"), ("최근", None, "UNRESOLVED"), ("13월", None, "UNRESOLVED")])
def test_time_expressions(spark, said, value, status):
    got = one(spark, D.normalise_expression(F.col("t"), F.lit("2024-05-25").cast("date")), t=said)
    assert (got["value"], got["status"]) == (value, status)
