"""Neighbourhood, merge, interval and routing queries over the stand-in graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import graph as G
from ..operators import routing as R
from . import tables as T
from .registry import register

_EDGES = """WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, max(1 - l_discount) AS confidence FROM lineitem GROUP BY 1, 2),
b AS (SELECT src || '>' || dst AS id, src, dst, confidence FROM e UNION ALL SELECT src || '>' || dst, dst, src, confidence FROM e),
g AS (SELECT src AS node, count(*) AS degree FROM b GROUP BY 1)
"""


def _neighbors(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    e = T.edges(spark, sf_dir)
    centre = e.select(F.lit("s1").alias("node")).limit(1)
    best = G.paths(e, centre, depth, hub_limit=300).groupBy("node").agg(F.max("score").alias("path"), F.min("hops").alias("hops"))
    scored = best.join(G.degrees(e), "node")
    score = F.col("path") * S.article_support(F.col("degree")) / S.hub_damping(F.col("degree"), 40.0)
    out = scored.select("node", "hops", "degree", F.round(score, 9).alias("score"))
    return out.orderBy(F.desc("score"), "node").limit(300)


def _neighbors_sql(depth: int) -> str:
    hops, name = ["SELECT dst AS node, 1 AS hops, confidence AS p, [id] AS used FROM b WHERE src = 's1'"], "h1"
    ctes = [f"h1 AS ({hops[0]})"]
    for k in range(2, depth + 1):
        ctes.append(f"h{k} AS (SELECT b.dst AS node, {k} AS hops, p * b.confidence AS p, list_append(used, b.id) AS used FROM h{k - 1} h JOIN g ON g.node = h.node AND g.degree <= 300 JOIN b ON b.src = h.node AND NOT list_contains(h.used, b.id))")
    del name
    every = " UNION ALL ".join(f"SELECT node, hops, p / hops AS s FROM h{k} WHERE node <> 's1'" for k in range(1, depth + 1))
    return _EDGES + ", " + ", ".join(ctes) + f""", a AS ({every}), m AS (SELECT node, max(s) AS path, min(hops)::INT AS hops FROM a GROUP BY 1)
SELECT m.node, hops, degree, round(path * (1 + 0.1 * ln(1 + degree)) / (1 + ln(1 + greatest(degree - 40, 0) / 40.0)), 9) AS score FROM m JOIN g ON g.node = m.node ORDER BY score DESC, m.node LIMIT 300"""


@register("neighbors_hop1", _neighbors_sql(1))
def neighbors_hop1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbors(spark, sf_dir, 1)


@register("neighbors_hop2", _neighbors_sql(2))
def neighbors_hop2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbors(spark, sf_dir, 2)


@register("neighbors_hop3", _neighbors_sql(3))
def neighbors_hop3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbors(spark, sf_dir, 3)


@register("node_degrees", _EDGES + "SELECT node, degree FROM g")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(T.edges(spark, sf_dir))


@register("induced_edges", _EDGES + ", k AS (SELECT node FROM g WHERE degree >= 30) SELECT src, dst, round(confidence, 6) AS confidence FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k) AND src <> dst")
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.edges(spark, sf_dir)
    return G.induced(e, G.degrees(e).filter("degree >= 30")).select("src", "dst", F.round("confidence", 6).alias("confidence"))


@register("edge_merge_max_conf", """SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, round(max(1 - l_discount), 6) AS confidence, bool_or(l_linenumber = 1) AS is_primary, min(l_shipdate) AS created_at FROM lineitem GROUP BY 1, 2""")
def edge_merge_max_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.edges(spark, sf_dir).select("src", "dst", F.round("confidence", 6).alias("confidence"), "is_primary", "created_at")


@register("one_primary_per_article", """SELECT l_orderkey AS article, l_partkey AS event, l_linenumber AS place, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_linenumber = 2 AS INT) DESC, l_linenumber, l_partkey) = 1 AS is_primary FROM lineitem""")
def one_primary_per_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article"), F.col("l_partkey").alias("event"), F.col("l_linenumber").alias("place"), (F.col("l_linenumber") == 2).alias("is_primary"))
    return G.one_primary(c)


@register("primary_by_least_event", """WITH c AS (SELECT l_orderkey AS article, l_partkey AS event, max(1 - l_discount) AS confidence, bool_or(l_returnflag = 'R') AS flag FROM lineitem GROUP BY 1, 2)
SELECT article, event, round(confidence, 6) AS confidence, event = coalesce(min(CASE WHEN flag THEN event END) OVER w, min(event) OVER w) AS is_primary FROM c WINDOW w AS (PARTITION BY article)""")
def primary_by_least_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article"), F.col("l_partkey").alias("event"), (1 - F.col("l_discount")).alias("confidence"), (F.col("l_returnflag") == "R").alias("is_primary"))
    return G.primary_by_least_event(c).withColumn("confidence", F.round("confidence", 6))


@register("remap_edges", """WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), m AS (SELECT p_partkey AS old, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS kept FROM part)
SELECT DISTINCT src, m.kept AS dst FROM e JOIN m ON dst = old WHERE src <> m.kept""")
def remap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    # suppliers are numbered downwards from -1 meanwhile: they share no id with parts, which alone are merged
    e = T.table(spark, sf_dir, "lineitem").select((-F.col("l_suppkey") - 1).alias("src"), F.col("l_partkey").alias("dst")).distinct()
    m = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("old"), F.min("p_partkey").over(Window.partitionBy("p_brand", "p_size")).alias("kept"))
    return G.remap(e, m).select((-F.col("src") - 1).alias("src"), "dst").filter("src <> dst").distinct()


_SPANS = """WITH a AS (SELECT l_orderkey AS article, l_linenumber AS id, CAST(l_quantity AS BIGINT) * 10 AS s, CAST(l_quantity AS BIGINT) * 10 + 15 AS e FROM lineitem),
b AS (SELECT l_orderkey AS article, l_linenumber AS id, CAST(l_quantity AS BIGINT) * 10 - 5 AS s, CAST(l_quantity AS BIGINT) * 10 + 40 AS e FROM lineitem)
"""


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li, q = T.table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long") * 10
    one = lambda lo, hi: li.select(F.col("l_orderkey").alias("article"), F.col("l_linenumber").alias("id"), (q + lo).alias("start"), (q + hi).alias("end"))
    return one(0, 15), one(-5, 40)


@register("interval_containment", _SPANS + "SELECT a.article, a.id AS inner_id, b.id AS outer_id FROM a JOIN b ON a.article = b.article AND b.s <= a.s AND a.e <= b.e")
def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.containing(*_spans(spark, sf_dir)).select("article", F.col("i_id").alias("inner_id"), F.col("o_id").alias("outer_id"))


@register("interval_overlap", _SPANS + "SELECT a.article, a.id AS left_id, b.id AS right_id FROM a JOIN b ON a.article = b.article AND a.s < b.e AND b.s < a.e")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overlapping(*_spans(spark, sf_dir)).select("article", F.col("i_id").alias("left_id"), F.col("o_id").alias("right_id"))


@register("nearest_anchor", """WITH p AS (SELECT user_id AS article, event_id AS id, floor(epoch(ts))::BIGINT AS at FROM events), a AS (SELECT user_id AS article, event_id AS anchor, floor(epoch(ts))::BIGINT AS at FROM events WHERE event_type = 'purchase')
SELECT p.article, p.id, p.at, arg_min(a.anchor, (abs(p.at - a.at)::BIGINT, a.anchor)) AS anchor FROM p LEFT JOIN a ON a.article = p.article GROUP BY 1, 2, 3""")
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = T.log(spark, sf_dir).select("user", "event_id", "kind", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', at)").alias("at"))
    points = log.select(F.col("user").alias("article"), F.col("event_id").alias("id"), "at")
    return R.nearest_anchor(points, log.filter("kind = 'purchase'").select(F.col("user").alias("article"), F.col("event_id").alias("anchor"), "at"))


@register("cap_by_role", """WITH c AS (SELECT l_partkey AS event, l_returnflag AS role, l_suppkey AS node, max(1 - l_discount) AS confidence FROM lineitem GROUP BY 1, 2, 3)
SELECT event, role, node, round(confidence, 6) AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY event, role ORDER BY c.confidence DESC, node) <= CASE role WHEN 'A' THEN 2 WHEN 'N' THEN 2 WHEN 'R' THEN 1 ELSE 0 END""")
def cap_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("event"), F.col("l_returnflag").alias("role"), F.col("l_suppkey").alias("node"), (1 - F.col("l_discount")).alias("confidence"))
    return R.cap_by_role(e, {"A": 2, "N": 2, "R": 1}).withColumn("confidence", F.round("confidence", 6))


@register("posting_candidates", """WITH k AS (SELECT DISTINCT o_custkey AS id, l_partkey AS key FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT a.id AS left_id, b.id AS right_id, count(*) AS shared FROM k a JOIN k b ON a.key = b.key AND a.id <> b.id GROUP BY 1, 2)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY shared DESC, right_id) <= 8""")
def posting_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = T.covers(spark, sf_dir).groupBy(F.col("user").alias("id")).agg(F.collect_set("event").alias("keys"))
    return R.posting_candidates(lists, lists, 8)


@register("accept_then_cap", """SELECT user_id AS "user", event_id AS id, value FROM events WHERE value >= 40 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 10""")
def accept_then_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.log(spark, sf_dir).select("user", F.col("event_id").alias("id"), F.col("value").alias("score"))
    return R.accept_then_cap(s, ["user"], 40.0, 10).withColumnRenamed("score", "value")


@register("graph_violations", """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT 'DANGLING' AS rule, s || '>' || p AS id FROM e WHERE p NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)""")
def graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.table(spark, sf_dir, "part").filter("p_size < 40").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("EVENT").alias("node_type"))
    sup = T.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("ENTITY").alias("node_type"))
    e = T.edges(spark, sf_dir).select("src", "type", "dst", F.regexp_replace("edge_id", "[sp]", "").alias("edge_id"))
    allowed = spark.range(1).select(F.lit("MENTIONS").alias("type"), F.lit("ENTITY").alias("src_type"), F.lit("EVENT").alias("dst_type"))
    return R.violations(parts.unionByName(sup), e, allowed)
