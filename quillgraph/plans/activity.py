"""Read-state, knowledge-node, replace-set, work-queue and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import temporal as D
from ..operators import routing as R
from ..operators import state
from ..sources import readers
from . import tables as T
from .registry import register


@register("read_state_upsert", """SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS INT) AS item, min(ts) AS first_at, max(ts) AS last_at, count(*) AS clicks FROM events GROUP BY 1, 2""")
def read_state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = T.log(spark, sf_dir).select("user", F.col("node").alias("item"), "at")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return state.merge_state(state.read_state(log.filter(F.col("at") < cut)), state.read_state(log.filter(F.col("at") >= cut)))


@register("knowledge_nodes", """SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS INT) AS node, count(DISTINCT event_id // 7) AS read_articles,
count(DISTINCT CASE WHEN event_type = 'purchase' THEN event_id // 7 END) AS primary_reads, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2""")
def knowledge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = T.log(spark, sf_dir).select("user", "node", F.floor(F.col("event_id") / 7).alias("article"), (F.col("kind") == "purchase").alias("is_primary"), "at")
    return state.knowledge_nodes(reads)


@register("knowledge_nodes_top", """WITH n AS (SELECT user_id AS u, event_type AS topic, CAST(json_extract_string(props, '$.k') AS INT) AS node, count(*) AS reads, CAST(sum(CAST(value > 50 AS INT)) AS BIGINT) AS clicks FROM events GROUP BY 1, 2, 3)
SELECT u AS "user", topic, node, reads, clicks FROM n QUALIFY row_number() OVER (PARTITION BY u, topic ORDER BY reads + clicks DESC, reads DESC, node) <= 5""")
def knowledge_nodes_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.log(spark, sf_dir).groupBy("user", F.col("kind").alias("topic"), "node").agg(F.count(F.lit(1)).alias("reads"), F.sum((F.col("value") > 50).cast("int")).alias("clicks"))
    return R.top_per(n, ["user", "topic"], [F.desc(F.col("reads") + F.col("clicks")), F.desc("reads"), F.col("node")], 5)


@register("user_vs_global", """WITH n AS (SELECT user_id AS u, CAST(json_extract_string(props, '$.k') AS INT) AS node, count(*) AS mine FROM events GROUP BY 1, 2)
SELECT a.u AS "user", a.node, a.mine, CAST(sum(b.mine) AS BIGINT) AS total FROM n a JOIN n b ON a.node = b.node GROUP BY 1, 2, 3""")
def user_vs_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.log(spark, sf_dir).groupBy("user", "node").agg(F.count(F.lit(1)).alias("mine"))
    return n.join(n.groupBy("node").agg(F.sum("mine").alias("total")), "node").select("user", "node", "mine", "total")


@register("consumed_left_favorite", """WITH c AS (SELECT user_id AS u, CAST(json_extract_string(props, '$.k') AS INT) AS node, count(*) AS clicks, max(ts) AS last_at FROM events GROUP BY 1, 2),
f AS (SELECT DISTINCT user_id AS u, CAST(json_extract_string(props, '$.k') AS INT) AS node FROM events WHERE value >= 90)
SELECT c.u AS "user", c.node, clicks, last_at, CASE WHEN f.u IS NULL THEN 0 ELSE 1 END AS favorited FROM c LEFT JOIN f ON c.u = f.u AND c.node = f.node WHERE clicks > 1 OR f.u IS NOT NULL OR c.node < 10""")
def consumed_left_favorite(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = T.log(spark, sf_dir)
    c = log.groupBy("user", "node").agg(F.count(F.lit(1)).alias("clicks"), F.max("at").alias("last_at"))
    f = log.filter("value >= 90").select("user", "node").distinct().withColumn("f", F.lit(1))
    out = c.join(f, ["user", "node"], "left").withColumn("favorited", F.coalesce("f", F.lit(0))).drop("f")
    return out.filter("clicks > 1 or favorited = 1 or node < 10")


@register("replace_set_sync", """WITH s AS (SELECT DISTINCT user_id AS u, CAST(json_extract_string(props, '$.k') AS INT) AS node FROM events WHERE ts < TIMESTAMP '2024-01-15'),
w AS (SELECT DISTINCT user_id AS u, CAST(json_extract_string(props, '$.k') AS INT) AS node FROM events WHERE ts >= TIMESTAMP '2024-01-15')
SELECT coalesce(s.u, w.u) AS "user", coalesce(s.node, w.node) AS node, CASE WHEN w.u IS NULL THEN 'DELETE' WHEN s.u IS NULL THEN 'ADD' ELSE 'KEEP' END AS action FROM s FULL JOIN w ON s.u = w.u AND s.node = w.node""")
def replace_set_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, cut = T.log(spark, sf_dir).select("user", "node", "at"), F.lit("2024-01-15").cast("timestamp_ntz")
    return state.replace_set(log.filter(F.col("at") < cut), log.filter(F.col("at") >= cut), ["user", "node"])


@register("valid_users", """WITH k AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS INT) AS node FROM events WHERE event_type = 'view')
SELECT user_id AS "user", bool_and(k.node IS NOT NULL) AS ok FROM events LEFT JOIN k ON CAST(json_extract_string(props, '$.k') AS INT) = k.node GROUP BY 1""")
def valid_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = T.log(spark, sf_dir)
    return state.valid_users(log.select("user", "node"), log.filter("kind = 'view'"))


@register("queue_depth", """SELECT event_type AS kind, count(*) AS depth, CAST(floor(epoch(TIMESTAMP '2024-02-01' - min(ts)) / 60) AS BIGINT) AS oldest_wait_minutes FROM events GROUP BY 1""")
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    wait = F.expr("timestampdiff(MINUTE, min(at), timestamp_ntz'2024-02-01')").cast("long")
    return T.log(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("depth"), wait.alias("oldest_wait_minutes"))


@register("stop_after_failures", """WITH r AS (SELECT l_suppkey AS batch, l_orderkey * 10 + l_linenumber AS seq, l_returnflag <> 'R' AS ok FROM lineitem),
g AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY batch ORDER BY seq) AS g FROM r),
f AS (SELECT *, sum(CAST(NOT ok AS INT)) OVER (PARTITION BY batch, g ORDER BY seq) AS f FROM g),
s AS (SELECT *, min(CASE WHEN f >= 3 THEN seq END) OVER (PARTITION BY batch) AS s FROM f)
SELECT batch, seq, ok FROM s WHERE s IS NULL OR seq <= s""")
def stop_after_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("batch"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_returnflag") != "R").alias("ok"))
    return state.stop_after_failures(runs, 3)


@register("chunk_roll_up", """WITH s AS (SELECT l_suppkey AS run, CAST(sum(CAST(l_returnflag <> 'R' AS INT)) AS BIGINT) AS succeeded, CAST(sum(CAST(l_returnflag = 'R' AS INT)) AS BIGINT) AS failed FROM lineitem GROUP BY 1)
SELECT *, CASE WHEN failed = 0 THEN 'COMPLETED' WHEN succeeded = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM s""")
def chunk_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("l_returnflag") == "R").cast("int")
    return state.roll_up(T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), (1 - bad).alias("succeeded"), bad.alias("failed")))


@register("user_chunks", """SELECT c_custkey AS "user", CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 100 AS BIGINT) AS chunk, c_nationkey AS shard FROM customer""")
def user_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.floor((rn - 1) / 100).alias("chunk"), F.col("c_nationkey").alias("shard"))


@register("url_normalize", r"""WITH p AS (SELECT page_id, trim(url) AS u FROM pages),
q AS (SELECT *, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$', ['s', 'h', 'p', 'q', 'f']) AS m FROM p),
a AS (SELECT page_id, m, list_filter(string_split(substr(m.q, 2), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid|igshid)(=|$)')) AS args FROM q)
SELECT page_id, lower(m.s) || '://' || lower(m.h) || m.p || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS url,
sha256(lower(m.s) || '://' || lower(m.h) || m.p || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END) AS url_hash FROM a""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = X.normalise_url(F.col("url"))
    return T.table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.sha2(url, 256).alias("url_hash"))


_HASHED = r"""WITH p AS (SELECT page_id, trim(url) AS u FROM pages),
q AS (SELECT *, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$', ['s', 'h', 'p', 'q', 'f']) AS m FROM p),
a AS (SELECT page_id, m, list_filter(string_split(substr(m.q, 2), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid|igshid)(=|$)')) AS args FROM q),
n AS (SELECT page_id, lower(m.s) || '://' || lower(m.h) || m.p || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS url FROM a)
"""


@register("url_hash_dedup", _HASHED + """SELECT sha256(url) AS url_hash, url, page_id FROM n QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id % 9, page_id) = 1""")
def url_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each normalised url, by the category that its request would have been of, then by place."""
    url = X.normalise_url(F.col("url"))
    category = F.element_at(F.array(*[F.lit(c) for c in readers.CATEGORIES]), (F.col("page_id") % len(readers.CATEGORIES) + 1).cast("int"))
    rows = T.table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.sha2(url, 256).alias("url_hash"), category.alias("category"), F.col("page_id").alias("pos"))
    return readers.first_by_category(rows).select("url_hash", "url", "page_id")


@register("content_collision", """WITH g AS (SELECT sha256(substr(text, strpos(text, chr(10)) + 1)) AS h, count(DISTINCT string_split(text, chr(10))[1]) AS titles, count(*) AS n FROM documents GROUP BY 1)
SELECT h, titles, n FROM g WHERE titles > 1""")
def content_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select(F.sha2(F.expr("substring(text, instr(text, '\n') + 1)"), 256).alias("h"), F.split("text", "\n")[0].alias("title"))
    return d.groupBy("h").agg(F.count_distinct("title").alias("titles"), F.count(F.lit(1)).alias("n")).filter("titles > 1")


@register("clean_body_lines")
def clean_body_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select("doc_id", X.clean_lines(F.col("text")).alias("lines"), X.clean_body(F.col("text"), F.split("text", "\n")[0]).alias("body"))


@register("previews", """SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' WHEN trim(text) <> '' THEN text END AS preview FROM documents""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@register("bigram_jaccard_pairs", """WITH b AS (SELECT item_id, list_distinct(list_transform(generate_series(1, length(s) - 1), lambda i: substr(s, i, 2))) AS g FROM (SELECT item_id, lower(regexp_replace(text, '\\s+', '', 'g')) AS s FROM benchmark))
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS jaccard FROM b a JOIN b b ON a.item_id < b.item_id""".replace("\\\\s", "\\s"))
def bigram_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = T.table(spark, sf_dir, "benchmark").select("item_id", X.bigrams(F.col("text")).alias("g"))
    x, y = b.alias("x"), b.alias("y")
    return x.join(y, F.col("x.item_id") < F.col("y.item_id")).select(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"), F.round(X.jaccard(F.col("x.g"), F.col("y.g")), 6).alias("jaccard"))


_LABELS = """WITH n AS (SELECT 'part' AS kind, p_partkey AS id, p_name AS label FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer),
s AS (SELECT *, CAST(contains(label, '00') AS INT) + CAST(contains(label, '1') AS INT) + CAST(contains(label, 'e') AS INT) AS hits FROM n),
t AS (SELECT *, CASE WHEN label = '00 1 e' THEN 3 WHEN hits = 3 THEN 2 WHEN hits > 0 THEN 1 ELSE 0 END AS tier FROM s)
"""


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = lambda t, k, n: T.table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(k).alias("id"), F.col(n).alias("label"))
    n = cols("part", "p_partkey", "p_name").unionByName(cols("supplier", "s_suppkey", "s_name")).unionByName(cols("customer", "c_custkey", "c_name"))
    tokens = ["00", "1", "e"]
    return n.withColumn("hits", X.matched_tokens(F.col("label"), tokens)).withColumn("tier", X.search_tier(F.col("label"), "00 1 e", tokens)).filter("tier > 0")


@register("search_rank", _LABELS + "SELECT kind, id, label, hits, tier FROM t WHERE tier > 0 ORDER BY tier DESC, hits DESC, kind, id LIMIT 50")
def search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).orderBy(F.desc("tier"), F.desc("hits"), "kind", "id").limit(50)


@register("search_keyset_page2", _LABELS + """SELECT kind, id, label, hits, tier FROM t WHERE tier > 0 AND (tier < 2 OR (tier = 2 AND (hits < 3 OR (hits = 3 AND (kind > 'customer' OR (kind = 'customer' AND id > 60))))))
ORDER BY tier DESC, hits DESC, kind, id LIMIT 21""")
def search_keyset_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [("tier", True), ("hits", True), ("kind", False), ("id", False)]
    return state.keyset_page(_search(spark, sf_dir), order, {"tier": 2, "hits": 3, "kind": "customer", "id": 60}, 20)


@register("time_normalize", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS full_date, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS yesterday,
CAST(year(o_orderdate) - 1 AS VARCHAR) AS last_year FROM orders""")
def time_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.to_date("o_orderdate")
    said = lambda fmt: F.date_format("o_orderdate", fmt)
    told = lambda text: D.normalise_expression(text, base)["value"]
    return T.table(spark, sf_dir, "orders").select(
        "o_orderkey", told(said("yyyy'년 'M'월 'd'일'")).alias("full_date"), told(said("M'월'")).alias("month"), told(F.lit("어제")).alias("yesterday"), told(F.lit("지난해")).alias("last_year")
    )


@register("stratified_sample_month", """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS m FROM orders), k AS (SELECT count(DISTINCT m) AS k, min(m) AS lead FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY o_orderkey) AS rn FROM o)
SELECT o_orderkey FROM r, k WHERE rn <= greatest(1, 500 // k) + CASE WHEN m = lead THEN greatest(0, 500 - greatest(1, 500 // k) * k) ELSE 0 END ORDER BY o_orderkey LIMIT 500""")
def stratified_sample_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return readers.stratified_sample(o, F.date_format("o_orderdate", "yyyy-MM"), F.col("o_orderkey"), 500).select("o_orderkey")


@register("analysis_transition", """SELECT o_orderkey AS article, CASE WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '1%' THEN 'COMPLETED' WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '2%' THEN 'DROPPED'
WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '3%' AND o_custkey % 3 + 1 >= 3 THEN 'FAILED' WHEN o_orderstatus = 'O' THEN 'PROCESSING' ELSE 'COMPLETED' END AS status,
CAST(o_custkey % 3 + CASE WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '3%' THEN 1 ELSE 0 END AS BIGINT) AS attempts FROM orders""")
def analysis_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    articles = o.select(F.col("o_orderkey").alias("article"), F.when(F.col("o_orderstatus") == "O", "PROCESSING").otherwise("COMPLETED").alias("status"), (F.col("o_custkey") % 3).alias("attempts"))
    outcomes = o.select(F.col("o_orderkey").alias("article"), F.when(p == "1", "OK").when(p == "2", "DROP").when(p == "3", "ERROR").alias("outcome"))
    return state.analysis_transition(articles, outcomes)
