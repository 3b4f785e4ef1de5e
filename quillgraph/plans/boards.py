"""Trend, topic, history, report and snapshot queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import temporal as D
from ..operators import routing as R
from ..operators import state
from . import tables as T
from .registry import register

LO, HI = "2001-05-01", "2001-08-02"


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.covers(spark, sf_dir).filter("is_primary").filter((F.col("published_at") >= F.lit(LO).cast("timestamp_ntz")) & (F.col("published_at") < F.lit(HI).cast("timestamp_ntz")))
    n = c.groupBy("event").agg(F.count_distinct("article").alias("article_count"), F.max("published_at").alias("latest"))
    return n.join(T.events(spark, sf_dir), "event")


_BEST = """WITH n AS (SELECT l_partkey AS event, count(DISTINCT l_orderkey) AS article_count, max(o_orderdate) AS latest
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND o_orderdate >= TIMESTAMP '2001-05-01' AND o_orderdate < TIMESTAMP '2001-08-02' GROUP BY 1),
e AS (SELECT n.*, p_name AS title, p_brand AS story, p_type AS topic FROM n JOIN part ON event = p_partkey)
"""


@register("trend_top_events", _BEST + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY article_count DESC, latest DESC, event) AS rn FROM e) WHERE rn = 1)
SELECT row_number() OVER (ORDER BY article_count DESC, latest DESC, event)::INT AS rank, event, title, story, article_count, latest FROM b QUALIFY rank <= 10""")
def trend_top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("article_count"), F.desc("latest"), F.col("event")]
    best = R.top_per(_counted(spark, sf_dir), ["story"], order, 1)  # one row a story
    top = best.orderBy(*order).limit(10)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "event", "title", "story", "article_count", "latest")


@register("topic_exploration", _BEST + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic, story ORDER BY article_count DESC, latest DESC, event) AS rn FROM e) WHERE rn = 1),
r AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY article_count DESC, latest DESC, event)::INT AS rank, event, article_count FROM b)
SELECT * FROM r WHERE rank <= 10""")
def topic_exploration(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("article_count"), F.desc("latest"), F.col("event")]
    best = R.top_per(_counted(spark, sf_dir), ["topic", "story"], order, 1)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(*order)))
    return ranked.filter("rank <= 10").select("topic", "rank", "event", "article_count")


@register("news_report_sources", """WITH n AS (SELECT c_mktsegment AS source, count(*) AS reads FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT source, reads, CAST(round(CAST(reads AS DECIMAL(18,0)) * 100 / (SELECT sum(reads) FROM n), 1) AS DOUBLE) AS share FROM n""")
def news_report_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("source"))
    n = T.table(spark, sf_dir, "orders").select("o_custkey").join(c, "o_custkey").groupBy("source").agg(F.count(F.lit(1)).alias("reads"))
    return n.withColumn("share", S.percent(F.col("reads"), F.sum("reads").over(Window.partitionBy(F.lit(0)))))


@register("source_top4_other", """WITH n AS (SELECT source, count(*) AS reads FROM documents GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY reads DESC, source) AS rn, count(*) OVER () AS k FROM n)
SELECT CASE WHEN k > 5 AND rn > 4 THEN 'other' ELSE source END AS source, CAST(sum(reads) AS BIGINT) AS reads FROM r GROUP BY 1""")
def source_top4_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("reads"))
    r = n.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("reads"), "source"))).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    return r.groupBy(F.when((F.col("k") > 5) & (F.col("rn") > 4), "other").otherwise(F.col("source")).alias("source")).agg(F.sum("reads").alias("reads"))


@register("weekly_topic_matrix", """WITH w AS (SELECT (SELECT date_trunc('week', max(ts)) FROM events) - INTERVAL 7 DAY * i AS week FROM generate_series(0, 11) g(i)),
t AS (SELECT DISTINCT event_type AS topic FROM events),
n AS (SELECT date_trunc('week', ts) AS week, event_type AS topic, count(*) AS n FROM events GROUP BY 1, 2)
SELECT CAST(w.week AS TIMESTAMP) AS week, t.topic, coalesce(n.n, 0) AS n FROM w CROSS JOIN t LEFT JOIN n ON n.week = w.week AND n.topic = t.topic""")
def weekly_topic_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = T.log(spark, sf_dir)
    ntz = lambda c: c.cast("timestamp_ntz")
    last = log.agg(ntz(D.week_start(F.max("at"))).alias("last"))
    weeks = last.select(F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"), "last").select((F.col("last") - F.make_dt_interval(F.col("i") * 7)).alias("week"))
    topics = log.select(F.col("kind").alias("topic")).distinct()
    n = log.groupBy(ntz(D.week_start(F.col("at"))).alias("week"), F.col("kind").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return weeks.crossJoin(topics).join(n, ["week", "topic"], "left").select("week", "topic", F.coalesce("n", F.lit(0)).alias("n"))


@register("entity_landscape", """WITH n AS (SELECT user_id AS user, CAST(json_extract_string(props, '$.k') AS INT) AS node, count(*) AS mine FROM events GROUP BY 1, 2),
g AS (SELECT node, CAST(sum(mine) AS BIGINT) AS total FROM n GROUP BY 1),
r AS (SELECT n.*, total, row_number() OVER (PARTITION BY n.user ORDER BY mine DESC, n.node) AS rn FROM n JOIN g ON n.node = g.node),
t AS (SELECT *, ln(1 + mine) AS a, ln(1 + total) AS b FROM r WHERE rn <= 12),
m AS (SELECT *, min(a) OVER u AS a0, max(a) OVER u AS a1, min(b) OVER u AS b0, max(b) OVER u AS b1 FROM t WINDOW u AS (PARTITION BY t.user))
SELECT m.user AS "user", node, mine, total, round(12 + 76 * (CASE WHEN a1 - a0 < 1e-12 THEN 0.5 ELSE (a - a0) / (a1 - a0) END), 4) AS x,
round(12 + 76 * (CASE WHEN b1 - b0 < 1e-12 THEN 0.5 ELSE (b - b0) / (b1 - b0) END), 4) AS y FROM m""")
def entity_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.log(spark, sf_dir).groupBy("user", "node").agg(F.count(F.lit(1)).alias("mine"))
    total = n.groupBy("node").agg(F.sum("mine").alias("total"))
    top = R.top_per(n, ["user"], [F.desc("mine"), F.col("node")], 12).join(total, "node")
    w = Window.partitionBy("user")

    def place(c: str):
        v = F.log1p(F.col(c).cast("double"))
        lo, hi = F.min(v).over(w), F.max(v).over(w)
        return F.round(12 + 76 * F.when(hi - lo < 1e-12, 0.5).otherwise((v - lo) / (hi - lo)), 4)

    return top.select("user", "node", "mine", "total", place("mine").alias("x"), place("total").alias("y"))


@register("personal_summary", """WITH n AS (SELECT user_id AS u, event_type AS topic, CAST(json_extract_string(props, '$.k') AS INT) AS node, count(*) AS engagement FROM events GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY u, topic ORDER BY engagement DESC, node) AS rn, sum(engagement) OVER (PARTITION BY u, topic) AS te FROM n),
m AS (SELECT *, max(te) OVER (PARTITION BY u) AS tm, max(engagement) OVER (PARTITION BY u) AS em FROM r)
SELECT u AS "user", topic, node, engagement, round(te / tm, 6) AS cluster_weight, round(engagement / em, 6) AS node_weight FROM m WHERE rn <= 5""")
def personal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.log(spark, sf_dir).groupBy("user", F.col("kind").alias("topic"), "node").agg(F.count(F.lit(1)).alias("engagement"))
    by = Window.partitionBy("user", "topic")
    r = n.withColumn("rn", F.row_number().over(by.orderBy(F.desc("engagement"), "node"))).withColumn("te", F.sum("engagement").over(by))
    u = Window.partitionBy("user")
    weights = [F.round(S.divide_by_max(F.col("te"), F.max("te").over(u)), 6).alias("cluster_weight"), F.round(S.divide_by_max(F.col("engagement"), F.max("engagement").over(u)), 6).alias("node_weight")]
    return r.select("user", "topic", "node", "engagement", "rn", *weights).filter("rn <= 5").drop("rn")


@register("period_summary", """WITH d AS (SELECT DISTINCT user_id AS u, event_id // 7 AS article, CAST(json_extract_string(props, '$.k') AS INT) AS node FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'),
n AS (SELECT u, node, count(*) AS reads FROM d GROUP BY 1, 2)
SELECT u AS "user", node, reads FROM n QUALIFY row_number() OVER (PARTITION BY u ORDER BY reads DESC, node) <= 5""")
def period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = D.day_range("2024-01-08", "2024-01-21")
    d = T.log(spark, sf_dir).filter((F.col("at") >= lo) & (F.col("at") < hi)).select("user", F.floor(F.col("event_id") / 7).alias("article"), "node").distinct()
    n = d.groupBy("user", "node").agg(F.count(F.lit(1)).alias("reads"))
    return R.top_per(n, ["user"], [F.desc("reads"), F.col("node")], 5)


@register("history_keyset", """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' OR (o_orderdate = TIMESTAMP '1998-06-01' AND o_orderkey < 5000)
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21""")
def history_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return state.keyset_page(o, [("o_orderdate", True), ("o_orderkey", True)], {"o_orderdate": datetime(1998, 6, 1), "o_orderkey": 5000}, 20)


@register("related_articles", """SELECT l_partkey AS event, count(DISTINCT l_orderkey) AS total, max(o_orderdate) AS latest FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def related_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.covers(spark, sf_dir).groupBy("event").agg(F.count_distinct("article").alias("total"), F.max("published_at").alias("latest"))


@register("event_articles_top3", """WITH a AS (SELECT l_partkey AS event, l_orderkey AS article, max(1 - l_discount) AS confidence, max(o_orderdate) AS published_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT event, article, round(confidence, 6) AS confidence FROM a QUALIFY row_number() OVER (PARTITION BY event ORDER BY confidence DESC, published_at DESC, article DESC) <= 3""")
def event_articles_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.covers(spark, sf_dir).groupBy("event", "article").agg(F.max("confidence").alias("confidence"), F.max("published_at").alias("published_at"))
    return R.top_per(a, ["event"], [F.desc("confidence"), F.desc("published_at"), F.desc("article")], 3).select("event", "article", F.round("confidence", 6).alias("confidence"))


@register("snapshot_latest_visible", """WITH s AS (SELECT o_orderpriority AS topic, o_orderkey, date_trunc('month', o_orderdate) AS snapshot_at FROM orders),
m AS (SELECT topic, max(snapshot_at) AS snapshot_at FROM s WHERE snapshot_at <= TIMESTAMP '1999-03-15' GROUP BY 1)
SELECT s.topic, s.o_orderkey, CAST(s.snapshot_at AS TIMESTAMP) AS snapshot_at FROM s JOIN m ON s.topic = m.topic AND s.snapshot_at = m.snapshot_at""")
def snapshot_latest_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("topic"), "o_orderkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("snapshot_at"))
    return state.latest_visible(s, F.lit("1999-03-15").cast("timestamp_ntz"), ["topic"])


@register("cycle_windows", """SELECT event_id, CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS cycle,
CAST(date_trunc('day', ts) + CASE WHEN hour(ts) < 12 THEN INTERVAL 6 HOUR ELSE INTERVAL 18 HOUR END AS TIMESTAMP) AS available_at,
CAST(CASE WHEN hour(ts) >= 17 THEN date_trunc('day', ts) + INTERVAL 17 HOUR WHEN hour(ts) >= 5 THEN date_trunc('day', ts) + INTERVAL 5 HOUR ELSE date_trunc('day', ts) - INTERVAL 7 HOUR END AS TIMESTAMP) AS slot,
CAST(date_trunc('hour', ts + INTERVAL 1 HOUR) AS TIMESTAMP) AS publish_at FROM events""")
def cycle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("at")
    ntz = lambda c, n: c.cast("timestamp_ntz").alias(n)
    return T.log(spark, sf_dir).select("event_id", D.cycle(at).alias("cycle"), ntz(D.cycle_available(at), "available_at"), ntz(D.latest_slot(at), "slot"), ntz(D.next_hour(at), "publish_at"))


@register("sliding_24h_12h", """WITH b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
w AS (SELECT TIMESTAMP '2000-01-01 05:00:00' + INTERVAL 12 HOUR * i AS s FROM b, generate_series(CAST(datediff('hour', TIMESTAMP '2000-01-01', lo) // 12 - 4 AS BIGINT), CAST(datediff('hour', TIMESTAMP '2000-01-01', hi) // 12 + 4 AS BIGINT)) g(i))
SELECT CAST(s AS TIMESTAMP) AS window_start, CAST(s + INTERVAL 24 HOUR AS TIMESTAMP) AS window_end, event_type, count(*) AS n FROM w JOIN events ON ts >= s AND ts < s + INTERVAL 24 HOUR GROUP BY 1, 2, 3""")
def sliding_24h_12h(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.jobs import sliding_counts

    out = sliding_counts(T.table(spark, sf_dir, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n")


@register("story_coverage", """WITH c AS (SELECT DISTINCT o_custkey AS u, l_partkey AS event FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT p_brand AS story, count(*) AS total FROM part GROUP BY 1)
SELECT u AS "user", p_brand AS story, count(*) AS consumed, total, round(count(*) / total, 6) AS coverage FROM c JOIN part ON event = p_partkey JOIN t ON p_brand = story GROUP BY u, p_brand, total""")
def story_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.events(spark, sf_dir)
    total = e.groupBy("story").agg(F.count(F.lit(1)).alias("total"))
    c = T.consumed(spark, sf_dir).select("user", "event").join(e.select("event", "story"), "event").groupBy("user", "story").agg(F.count(F.lit(1)).alias("consumed"))
    return c.join(total, "story").select("user", "story", "consumed", "total", F.round(F.col("consumed") / F.col("total"), 6).alias("coverage"))


@register("corpus_audit", """WITH n AS (SELECT source, lang, count(*) AS docs, count(DISTINCT sha256(text)) AS texts, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY 1, 2)
SELECT *, round(100.0 * docs / (SELECT sum(docs) FROM n), 4) AS share FROM n""")
def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select("source", "lang", "n_chars", F.sha2("text", 256).alias("h"))
    n = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("h").alias("texts"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))
    return n.withColumn("share", F.round(100.0 * F.col("docs") / F.sum("docs").over(Window.partitionBy(F.lit(0))), 4))


@register("repeated_lines", """SELECT line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 40 GROUP BY 1 HAVING count(*) > 1""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= 40)
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")).filter("n > 1")
