"""Lookup, item, cursor, alias and small state-change queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lookup as L
from . import tables as T
from .registry import register


@register("optional_topic_filter", """SELECT 'all' AS asked, count(*) AS n FROM part UNION ALL SELECT 'some', count(*) FROM part WHERE p_size IN (1, 7, 20)""")
def optional_topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = T.table(spark, sf_dir, "part")
    count = lambda name, values: L.optional_in(part, "p_size", values).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("asked"), "n")
    return count("all", []).unionByName(count("some", [1, 7, 20]))


_QUEUE = """q AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'view' THEN 'PROCESSING' ELSE 'DONE' END AS status,
  CASE WHEN value < 50 THEN NULL ELSE user_id END AS node, CAST(event_id % 5 AS INTEGER) AS attempts FROM events)"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") == "view", "PROCESSING").otherwise("DONE").alias("status"),
        F.when(F.col("value") < 50, None).otherwise(F.col("user_id")).alias("node"), (F.col("event_id") % 5).cast("int").alias("attempts"),
    )


@register("claimable_work", f"WITH {_QUEUE} SELECT event_id, attempts FROM q WHERE status = 'PROCESSING' AND node IS NULL AND attempts < 3")
def claimable_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.claimable(_queue(spark, sf_dir), 3).select("event_id", "attempts")


@register("claim_by_lease", f"""WITH {_QUEUE} SELECT event_id, node IS NULL OR ts < (SELECT max(ts) FROM events) - INTERVAL 5 DAY AS won,
  CASE WHEN node IS NULL OR ts < (SELECT max(ts) FROM events) - INTERVAL 5 DAY THEN 'me' ELSE CAST(node AS VARCHAR) END AS owner FROM q""")
def claim_by_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _queue(spark, sf_dir)
    now = q.agg((F.max("ts") - F.expr("interval 5 days")).alias("now"))  # one row
    rows = q.withColumn("owner", F.col("node").cast("string")).withColumnRenamed("ts", "lease").crossJoin(F.broadcast(now))
    return L.claim(rows, "me", F.col("now")).select("event_id", "won", "owner")


@register("live_rows", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE CASE WHEN c_acctbal < 0 THEN 1 END IS NULL GROUP BY 1")
def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.table(spark, sf_dir, "customer").withColumn("deleted_at", F.when(F.col("c_acctbal") < 0, F.lit(1)))
    return c.filter(F.col("deleted_at").isNull()).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@register("valid_stored_items", """WITH i AS (SELECT o_custkey AS "user", l_partkey AS event, l_linenumber AS rank, o_orderpriority AS kind, l_extendedprice AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
e AS (SELECT *, row_number() OVER (PARTITION BY "user", event ORDER BY rank, score DESC, kind) AS n FROM i),
r AS (SELECT * EXCLUDE n, row_number() OVER (PARTITION BY "user", rank ORDER BY event) AS n FROM e WHERE n = 1)
SELECT "user", event, rank, kind FROM r WHERE n = 1""")
def valid_stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("user"), F.col("o_orderpriority").alias("kind"))
    li = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("event"), F.col("l_linenumber").alias("rank"), F.col("l_extendedprice").alias("score"))
    return L.valid_items(li.join(o, "k"), ["1-URGENT", "2-HIGH"]).select("user", "event", "rank", "kind")


@register("first_known_label", """SELECT p_partkey AS event, CASE WHEN p_size > 25 THEN 'LARGE' WHEN p_retailprice > 1000 THEN 'DEAR' END AS label,
  CASE WHEN p_size > 25 THEN 'Event,LARGE' ELSE 'Event' END AS labels FROM part""")
def first_known_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part")
    large = F.when(F.col("p_size") > 25, F.lit("LARGE"))
    labels = F.concat(L.label_array("Event", large), L.label_array("Any", F.when(F.col("p_retailprice") > 1000, F.lit("DEAR"))))
    return p.select(F.col("p_partkey").alias("event"), L.first_label(labels, ["LARGE", "DEAR"]).alias("label"), F.concat_ws(",", L.label_array("Event", large)).alias("labels"))


@register("events_without_story", "SELECT p_partkey AS event FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)")
def events_without_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = T.table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("event"))
    return T.events(spark, sf_dir).select("event").join(told, "event", "left_anti")


@register("article_subgraph", """WITH c AS (SELECT 'a' || l_orderkey AS article, 'e' || l_partkey AS event FROM lineitem WHERE l_linenumber = 1),
k AS (SELECT 'a' || l_orderkey AS src, 's' || l_suppkey AS dst FROM lineitem WHERE l_linenumber = 2 UNION ALL SELECT 'e' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_returnflag = 'R'),
n AS (SELECT article, article AS src FROM c UNION SELECT article, event FROM c)
SELECT DISTINCT article, src, dst FROM n JOIN k USING (src)""")
def article_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T.table(spark, sf_dir, "lineitem")
    article, event, dst = (F.concat(F.lit(p), c) for p, c in (("a", "l_orderkey"), ("e", "l_partkey"), ("s", "l_suppkey")))
    covers = li.select(article.alias("article"), event.alias("event"), (F.col("l_linenumber") == 1).alias("is_primary"))
    links = li.filter("l_linenumber = 2").select(article.alias("src"), dst.alias("dst")).unionByName(li.filter("l_returnflag = 'R'").select(event.alias("src"), dst.alias("dst")))
    return L.article_subgraph(links, covers, primary_only=True)


@register("articles_in_asked_order", """WITH a AS (SELECT event_id * 3 AS o_orderkey, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS rank, user_id FROM events)
SELECT user_id, rank, o_orderkey AS article, o_orderdate AS published_at FROM a JOIN orders USING (o_orderkey)""")
def articles_in_asked_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    asked = e.select((F.col("event_id") * 3).alias("article"), rank.alias("rank"), "user_id")
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article"), F.col("o_orderdate").alias("published_at"))
    return L.fetch_in_order(asked, rows, "article").select("user_id", "rank", "article", "published_at")


@register("pairs_by_ids", """SELECT l_linenumber AS place, s_suppkey AS a, p_partkey AS b, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
WHERE l_returnflag = 'R' GROUP BY ALL""")
def pairs_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = T.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_linenumber").alias("place"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    a, b = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a")), T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("b"))
    return asked.join(a, "a").join(b, "b").groupBy("place", "a", "b").agg(F.count(F.lit(1)).alias("n"))


@register("items_of_user", """SELECT user_id AS "user", string_agg(event_id || ':' || event_type, ',' ORDER BY ts, event_id) AS items, count(*) AS n FROM events GROUP BY 1""")
def items_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))  # of one user
    return e.groupBy(F.col("user_id").alias("user")).agg(ordered.alias("l"), F.count(F.lit(1)).alias("n")).select(
        "user", F.concat_ws(",", F.transform("l", lambda x: F.concat_ws(":", x["event_id"], x["event_type"]))).alias("items"), "n")


@register("points_at_one_place", """SELECT n_regionkey AS x, s_nationkey % 4 AS y, count(*) AS n, bool_or(s_acctbal > 9000) AS strong, min(s_suppkey) AS first
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def points_at_one_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("x"))
    s = T.table(spark, sf_dir, "supplier").join(n, "s_nationkey")
    return s.groupBy("x", (F.col("s_nationkey") % 4).alias("y")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("s_acctbal") > 9000).alias("strong"), F.min("s_suppkey").alias("first"))


@register("topic_growth", """WITH w AS (SELECT o_orderpriority AS topic, datediff('day', o_orderdate::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) // 7 AS back FROM orders),
g AS (SELECT topic, count(*) FILTER (back < 4) AS recent, count(*) FILTER (back >= 4 AND back < 8) AS earlier, count(*) AS n FROM w GROUP BY 1)
SELECT topic, recent, earlier, n, recent - earlier AS growth, row_number() OVER (ORDER BY n DESC, topic)::INT AS rank,
  topic = (SELECT topic FROM g ORDER BY recent - earlier DESC, topic LIMIT 1) AS fastest FROM g""")
def topic_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("topic"), F.to_date("o_orderdate").alias("d"))
    last = o.agg(F.max("d").alias("last"))  # one row
    back = o.crossJoin(F.broadcast(last)).withColumn("back", F.floor(F.datediff("last", "d") / 7))
    g = back.groupBy("topic").agg(F.count_if(F.col("back") < 4).alias("recent"), F.count_if((F.col("back") >= 4) & (F.col("back") < 8)).alias("earlier"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("growth", F.col("recent") - F.col("earlier"))  # one row a topic
    best = g.orderBy(F.desc("growth"), "topic").limit(1).select(F.col("topic").alias("best"))
    ranked = g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "topic")))
    return ranked.crossJoin(F.broadcast(best)).select("topic", "recent", "earlier", "n", "growth", "rank", (F.col("topic") == F.col("best")).alias("fastest"))


@register("preferred_topic", """SELECT o_custkey AS "user", p_brand AS topic FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (l_linenumber = 1) DESC, p_brand) = 1""")
def preferred_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = T.events(spark, sf_dir).select("event", F.col("story").alias("topic"))
    c = T.covers(spark, sf_dir).join(topics, "event")
    best = c.groupBy("user").agg(F.min(F.struct((~F.col("is_primary")).alias("other"), "topic")).alias("b"))
    return best.select("user", "b.topic")


@register("month_labels", """WITH d AS (SELECT DISTINCT o_custkey AS "user", o_orderdate::DATE AS d FROM orders),
l AS (SELECT *, lag(d) OVER (PARTITION BY "user" ORDER BY d) AS p FROM d)
SELECT "user", d, CASE WHEN p IS NULL OR date_trunc('month', p) <> date_trunc('month', d) THEN strftime(d, '%Y-%m') END AS label FROM l""")
def month_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.to_date("o_orderdate").alias("d")).distinct()
    month = F.date_format("d", "yyyy-MM")
    before = F.lag(month).over(Window.partitionBy("user").orderBy("d"))
    return d.select("user", "d", F.when(before.isNull() | (before != month), month).alias("label"))


@register("page_cursors", """SELECT o_orderkey AS article, rtrim(replace(replace(to_base64(encode('1' || chr(10) || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || o_orderkey)), '+', '-'), '/', '_'), '=') AS cursor,
  o_orderkey AS id FROM orders""")
def page_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    o = o.withColumn("cursor", L.encode_cursor(F.col("at"), F.col("article")))
    return o.select("article", "cursor", L.decode_cursor(F.col("cursor"), 2)[1].cast("long").alias("id"))


@register("top_after_filters", """SELECT o_custkey AS "user", l_partkey AS event, max(l_extendedprice) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_returnflag <> 'R' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY max(l_extendedprice) DESC, l_partkey) <= 20""")
def top_after_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("user"))
    li = T.table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("event"), "l_extendedprice")
    best = li.join(o, "k").groupBy("user", "event").agg(F.max("l_extendedprice").alias("score"))
    n = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "event"))
    return best.withColumn("n", n).filter("n <= 20").drop("n")  # the report's own size


@register("signals_of_user", """SELECT user_id AS "user", 'favorite' AS kind, CAST(event_id AS VARCHAR) AS item FROM events WHERE event_type = 'purchase'
UNION ALL SELECT c_custkey, 'topic', c_mktsegment FROM customer""")
def signals_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    fav = T.table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("user"), F.lit("favorite").alias("kind"), F.col("event_id").cast("string").alias("item"))
    return fav.unionByName(T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.lit("topic").alias("kind"), F.col("c_mktsegment").alias("item")))


@register("aliases_added", """SELECT s_suppkey AS node, s_name || '|' || n_name || CASE WHEN s_nationkey % 2 = 0 THEN '' ELSE '|' || upper(s_name) || 'X' END AS aliases
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def aliases_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = T.table(spark, sf_dir, "supplier").join(n, "s_nationkey")
    name = F.when(F.col("s_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.upper("s_name"), F.lit("X")))  # the even ones have it already
    grown = L.add_alias(L.add_alias(F.array("s_name", "n_name"), name, F.lit("title")), F.lit("title"), F.lit("title"))
    return s.select(F.col("s_suppkey").alias("node"), F.concat_ws("|", grown).alias("aliases"))


@register("content_hashes", "SELECT doc_id, upper(sha256(coalesce(text, ''))) AS content_hash, substr(sha256('node:' || doc_id), 1, 32) AS node_id FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents")
    stored = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))  # 32 bytes, as it is kept
    return d.select("doc_id", F.hex(stored).alias("content_hash"), F.substring(F.sha2(F.concat(F.lit("node:"), "doc_id"), 256), 1, 32).alias("node_id"))


@register("users_of_run", "SELECT event_type AS run, '[' || string_agg(user_id, ',' ORDER BY user_id) || ']' AS users, count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY 1")
def users_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), "user_id").distinct()
    told = e.groupBy("run").agg(F.to_json(F.array_sort(F.collect_list("user_id"))).alias("users"))  # the column of a run
    return told.select("run", "users", F.size(F.from_json("users", "array<long>")).cast("long").alias("n"))


@register("latest_visible_cycle", """SELECT user_id AS "user", max(date_trunc('day', ts)) AS cycle FROM events e
WHERE EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'purchase' AND date_trunc('day', r.ts) = date_trunc('day', e.ts)) GROUP BY 1""")
def latest_visible_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("cycle"), "event_type")
    return e.join(e.filter("event_type = 'purchase'").select("cycle").distinct(), "cycle", "left_semi").groupBy("user").agg(F.max("cycle").alias("cycle"))


@register("organizations", """WITH k AS (SELECT s_suppkey AS org, 'd' || (s_suppkey % 40) AS domain, s_name AS name FROM supplier WHERE s_acctbal > 0),
a AS (SELECT DISTINCT 'd' || (s_suppkey % 60) AS domain, s_name AS name FROM supplier),
d AS (SELECT domain, min(org) AS o FROM k GROUP BY 1), n AS (SELECT name, min(org) AS o FROM k GROUP BY 1)
SELECT a.domain, a.name, coalesce(CAST(coalesce(d.o, n.o) AS VARCHAR), substr(sha256(a.domain || chr(10) || a.name), 1, 16)) AS org, coalesce(d.o, n.o) IS NULL AS is_new
FROM a LEFT JOIN d ON a.domain = d.domain LEFT JOIN n ON a.name = n.name""")
def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.table(spark, sf_dir, "supplier")
    domain = lambda k: F.concat(F.lit("d"), (F.col("s_suppkey") % k).cast("string")).alias("domain")
    known = s.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("org"), domain(40), F.col("s_name").alias("name"))
    return L.resolve_organization(s.select(domain(60), F.col("s_name").alias("name")), known)


@register("bookmark_changes", """WITH h AS (SELECT DISTINCT user_id AS "user", event_id % 500 AS node FROM events WHERE event_type = 'view'),
w AS (SELECT DISTINCT user_id AS "user", event_id % 500 AS node FROM events WHERE event_type <> 'view' AND event_id % 500 IN (SELECT p_partkey FROM part))
SELECT "user", node, 'ADD' AS change FROM w ANTI JOIN h USING ("user", node) UNION ALL SELECT "user", node, 'REMOVE' FROM h ANTI JOIN w USING ("user", node)""")
def bookmark_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), (F.col("event_id") % 500).alias("node"), "event_type")
    have = e.filter("event_type = 'view'").select("user", "node").distinct()
    return L.set_difference(have, e.filter("event_type <> 'view'"), T.events(spark, sf_dir).select(F.col("event").alias("node")), ["user", "node"])


@register("window_labels", """WITH e AS (SELECT l_orderkey AS item, l_linenumber AS w, label, exp(logit - max(logit) OVER (PARTITION BY l_orderkey, l_linenumber)) AS x
  FROM (SELECT l_orderkey, l_linenumber, unnest(['a', 'b', 'c']) AS label, unnest([l_quantity / 10, l_discount * 40, l_tax * 40]) AS logit FROM lineitem)),
p AS (SELECT item, label, avg(x / s) AS p FROM (SELECT *, sum(x) OVER (PARTITION BY item, w) AS s FROM e) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(p, 9) DESC, label) AS n FROM p)
SELECT item, max(CASE WHEN n = 1 THEN label END) AS label, max(CASE WHEN n = 2 AND round(p, 9) >= 0.3 THEN label END) AS second FROM r WHERE n <= 2 GROUP BY 1""")
def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    logit = lambda name, c: F.struct(F.lit(name).alias("label"), c.alias("logit"))
    each = F.array(logit("a", F.col("l_quantity") / 10), logit("b", F.col("l_discount") * 40), logit("c", F.col("l_tax") * 40))
    li = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("window"), F.explode(each).alias("l"))
    p = L.mean_softmax(li.select("item", "window", "l.label", "l.logit"))
    return L.two_labels(p.withColumn("p", F.round("p", 9)), 0.3)


@register("node_articles", """WITH r AS (SELECT DISTINCT l_partkey AS node, o_orderkey AS article, o_orderdate AS seen, o_custkey AS "user" FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
own AS (SELECT DISTINCT user_id AS "user" FROM events), b AS (SELECT DISTINCT user_id AS "user", event_id AS article FROM events WHERE event_type = 'purchase')
SELECT "user", node, article, row_number() OVER (PARTITION BY "user", node ORDER BY seen DESC, article DESC)::INT AS place, b.article IS NOT NULL AS bookmarked
FROM r SEMI JOIN own USING ("user") LEFT JOIN b USING ("user", article)""")
def node_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    read = T.covers(spark, sf_dir).select("user", F.col("event").alias("node"), "article", F.col("published_at").alias("at")).distinct()
    own = e.select(F.col("user_id").alias("user")).distinct()
    marked = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("user"), F.col("event_id").alias("article")).distinct().withColumn("m", F.lit(True))
    place = F.row_number().over(Window.partitionBy("user", "node").orderBy(F.desc("at"), F.desc("article")))
    return read.join(own, "user", "left_semi").join(marked, ["user", "article"], "left").select("user", "node", "article", place.alias("place"), F.coalesce("m", F.lit(False)).alias("bookmarked"))
