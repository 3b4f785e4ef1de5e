"""Recommendation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import evaluate as E
from ..operators import recommend as C
from . import tables as T
from .registry import register

AS_OF = "2001-08-02"
_CONSUMED = """WITH seen AS (SELECT o_custkey AS u, l_partkey AS e, count(*) AS clicks, max(o_orderdate) AS last_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
prim AS (SELECT DISTINCT l_partkey AS e FROM lineitem WHERE l_linenumber = 1)
"""
# seen: rows that users are scored by; pool: rows of their peers
_PEERS = """, size AS (SELECT u, count(*) AS n FROM seen GROUP BY 1), psize AS (SELECT u, count(*) AS n FROM pool GROUP BY 1),
sim AS (SELECT a.u, b.u AS peer, count(*) AS k FROM seen a JOIN pool b ON a.e = b.e AND a.u <> b.u GROUP BY 1, 2),
j AS (SELECT sim.u, peer, k / (x.n + y.n - k) AS s FROM sim JOIN size x ON x.u = sim.u JOIN psize y ON y.u = peer),
top AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY u ORDER BY s DESC, peer) <= 50),
raw AS (SELECT top.u, pool.e, sum(s) AS raw FROM top JOIN pool ON pool.u = top.peer JOIN prim ON prim.e = pool.e WHERE NOT EXISTS (SELECT 1 FROM seen o WHERE o.u = top.u AND o.e = pool.e) GROUP BY 1, 2),
cf AS (SELECT u, e, raw / max(raw) OVER (PARTITION BY u) AS cf FROM raw),
best AS (SELECT u, e, cf FROM cf QUALIFY row_number() OVER (PARTITION BY u ORDER BY round(cf, 9) DESC, e) <= 20)
"""
_CF = _CONSUMED + ", pool AS (SELECT * FROM seen)" + _PEERS
_CBF = """, vec AS (SELECT p_partkey AS e, CAST(embedding AS DOUBLE[]) AS v FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings)),
wt AS (SELECT u, e, ln(1 + clicks) * exp(-ln(2) * greatest(epoch(TIMESTAMP '2001-08-02' - last_at) / 86400.0, 0) / 300) AS w FROM seen),
pc AS (SELECT u, i, sum(w * v[i]) / sum(w) AS x FROM wt JOIN vec USING (e), generate_series(1, 64) t(i) GROUP BY 1, 2), pf AS (SELECT u, list(x ORDER BY i) AS v FROM pc GROUP BY 1),
near AS (SELECT pf.u, vec.e, round((1 + list_cosine_similarity(pf.v, vec.v)) / 2, 9) AS cbf FROM pf, vec SEMI JOIN prim ON prim.e = vec.e),
cb AS (SELECT u, e, cbf FROM near WHERE NOT EXISTS (SELECT 1 FROM seen o WHERE o.u = near.u AND o.e = near.e) QUALIFY row_number() OVER (PARTITION BY u ORDER BY cbf DESC, e) <= 20)
"""


def _cf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collaborative(T.consumed(spark, sf_dir), top=20).select("user", "event", "cf")


@register("cf_scores", _CF + 'SELECT u AS "user", e AS event, round(cf, 6) AS cf FROM best')
def cf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cf(spark, sf_dir).withColumn("cf", F.round("cf", 6))


@register("similar_users", _CF + 'SELECT u AS "user", peer, round(s, 9) AS similarity FROM top')
def similar_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.similar_users(T.consumed(spark, sf_dir)).withColumn("similarity", F.round("similarity", 9))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event"), "embedding", "label")


def _event_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event, embedding) of every event; the vectors are fewer, so some share one."""
    v = T.table(spark, sf_dir, "embeddings")
    n = v.agg(F.count(F.lit(1)).alias("k"))  # one row
    e = T.events(spark, sf_dir).crossJoin(F.broadcast(n)).select("event", (F.col("event") % F.col("k")).alias("vec_id"))
    return e.join(v.select("vec_id", "embedding"), "vec_id").select("event", "embedding")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.consumed(spark, sf_dir).withColumn("favorited", F.lit(False))


def _cbf(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    seen, v = seen or B.kept(_history(spark, sf_dir)), _event_vectors(spark, sf_dir)
    return C.content_of_history(seen, v, seen.filter("is_primary").select("event"), F.lit(AS_OF).cast("timestamp_ntz"), 300.0)


@register("cbf_similar", """WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, generate_series(1, 64) g(i) GROUP BY 1, 2), p AS (SELECT label, list(v ORDER BY i) AS v FROM c GROUP BY 1),
s AS (SELECT p.label AS profile, vec_id, round((1 + list_cosine_similarity(p.v, CAST(embedding AS DOUBLE[]))) / 2, 9) AS r FROM p, embeddings)
SELECT profile, vec_id, round(r, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY profile ORDER BY r DESC, vec_id) <= 20""")
def cbf_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    mean = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    p = mean.groupBy(F.col("label").alias("user")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("profile"))
    nothing = v.select(F.col("label").alias("user"), "event").limit(0)
    s = C.content_based(p, v, nothing)
    return s.select(F.col("user").cast(v.schema["label"].dataType).alias("profile"), F.col("event").alias("vec_id"), F.round("cbf", 6).alias("score"))


@register("cbf_scores", _CONSUMED + _CBF + 'SELECT u AS "user", e AS event, round(cbf, 6) AS cbf FROM cb')
def cbf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cbf(spark, sf_dir).withColumn("cbf", F.round("cbf", 6))


@register("user_profile_vector", """WITH w AS (SELECT user_id AS u, event_id % (SELECT count(*) FROM embeddings) AS vec_id, count(*) AS clicks, max(ts) AS last_at, max(value) >= 90 AS fav FROM events GROUP BY 1, 2),
x AS (SELECT u, vec_id, ln(1 + clicks) * exp(-ln(2) * (epoch(TIMESTAMP '2024-02-01' - last_at) / 86400.0) / 14) * CASE WHEN fav THEN 2 ELSE 1 END AS w FROM w)
SELECT u AS "user", i - 1 AS i, round(sum(w * CAST(embedding[i] AS DOUBLE)) / sum(w), 5) + 0.0 AS v FROM x JOIN embeddings USING (vec_id), generate_series(1, 64) g(i) GROUP BY 1, 2""")
def user_profile_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("k"))
    w = T.log(spark, sf_dir).crossJoin(n).groupBy("user", (F.col("event_id") % F.col("k")).alias("event")).agg(F.count(F.lit(1)).alias("clicks"), F.max("at").alias("last_viewed_at"), (F.max("value") >= 90).alias("favorited"))
    p = C.profiles(w, _vectors(spark, sf_dir).select("event", "embedding"), F.lit("2024-02-01").cast("timestamp_ntz"))
    return p.select("user", F.posexplode("profile").alias("i", "v")).select("user", F.col("i").cast("long").alias("i"), (F.round("v", 5) + 0.0).alias("v"))


_POP = """, n AS (SELECT e, count(DISTINCT u) AS c FROM seen GROUP BY 1),
ev AS (SELECT p_partkey AS e, p_brand AS story, p_type AS topic, coalesce(max(o_orderdate), TIMESTAMP '1995-01-01') AS latest FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
pop AS (SELECT ev.e, story, topic, ln(1 + coalesce(c, 0)) * exp(-ln(2) * greatest(epoch(TIMESTAMP '2001-08-02' - latest) / 86400.0, 0) / 300) AS score FROM ev LEFT JOIN n ON n.e = ev.e)
"""


def _popular(spark: SparkSession, sf_dir: str, users: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    c = T.covers(spark, sf_dir).groupBy("event").agg(F.max("published_at").alias("at"))
    e = T.events(spark, sf_dir).join(c, "event", "left").withColumn("updated_at", F.coalesce("at", F.lit("1995-01-01").cast("timestamp_ntz")))
    return C.cold_start(e, T.consumed(spark, sf_dir), users, F.lit(AS_OF).cast("timestamp_ntz"), wanted, half=300.0)


@register("cold_start_popularity", _CONSUMED + _POP + """, b AS (SELECT * FROM pop QUALIFY row_number() OVER (PARTITION BY story ORDER BY round(score, 9) DESC, e) = 1)
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, e)::INT AS rank, e AS event, story, round(score, 6) AS score FROM b QUALIFY rank <= 10""")
def cold_start_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    someone = spark.range(1).select(F.lit(-1).cast("long").alias("user"))  # a user without history
    scored = _popular(spark, sf_dir, someone).withColumn("score", F.round("score", 9)).join(T.events(spark, sf_dir).select("event", "story"), "event")
    return C.one_per_group(scored).select("rank", "event", "story", F.round("score", 6).alias("score"))


@register("blend_story_dedup", _CF + _CBF + """, bl AS (SELECT coalesce(best.u, cb.u) AS u, coalesce(best.e, cb.e) AS e, round(0.7 * coalesce(cbf, 0) + 0.3 * coalesce(cf, 0), 9) AS score FROM best FULL JOIN cb ON best.u = cb.u AND best.e = cb.e),
gr AS (SELECT bl.*, p_brand AS story, row_number() OVER (PARTITION BY u, p_brand ORDER BY score DESC, e) AS ig FROM bl JOIN part ON p_partkey = e),
kp AS (SELECT *, count(*) FILTER (WHERE ig = 1) OVER (PARTITION BY u) AS groups FROM gr),
rk AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, e)::INT AS rank FROM kp WHERE ig = 1 OR groups < 10)
SELECT u AS "user", e AS event, story, rank, round(score, 6) AS score FROM rk WHERE rank <= 10""")
def blend_story_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = B.kept(_history(spark, sf_dir))
    both = C.candidates(_cbf(spark, sf_dir, seen), C.collaborative(seen, top=20), T.events(spark, sf_dir))
    scored = both.withColumn("score", F.round(C.weighted(0.7, 0.3), 9))
    return C.one_per_group(scored).select("user", "event", "story", "rank", F.round("score", 6).alias("score"))


_HOLD = _CONSUMED + """, h AS (SELECT seen.*, prim.e IS NOT NULL AS el FROM seen LEFT JOIN prim ON prim.e = seen.e),
r AS (SELECT *, row_number() OVER (PARTITION BY u, el ORDER BY last_at DESC, e) AS rn, sum(CAST(el AS INT)) OVER (PARTITION BY u) AS n, count(*) OVER (PARTITION BY u) AS k FROM h),
held AS (SELECT u, e FROM r WHERE el AND rn <= greatest(1, round_even(n * 0.2, 0)) AND n > 0 AND k > greatest(1, round_even(n * 0.2, 0)))
"""


@register("holdout_split", _HOLD + 'SELECT u AS "user", e AS event FROM held')
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.consumed(spark, sf_dir).withColumn("eligible", F.col("is_primary"))
    return C.holdout(h).filter("held").select("user", "event")


@register("holdout_metrics", _HOLD + """, v AS (SELECT seen.e, count(*) AS c FROM seen ANTI JOIN held ON held.u = seen.u AND held.e = seen.e GROUP BY 1), rec AS (SELECT e, row_number() OVER (ORDER BY c DESC, e) AS rank FROM v QUALIFY rank <= 10),
sz AS (SELECT u, count(*) AS n FROM held GROUP BY 1), ht AS (SELECT u, sum(1 / log2(rank + 1)) AS dcg, count(*) AS k FROM held JOIN rec USING (e) GROUP BY 1)
SELECT sz.u AS "user", round(coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, least(n, 10)), lambda i: 1 / log2(i + 1))), 6) AS ndcg, CAST(coalesce(k, 0) > 0 AS DOUBLE) AS hit, round(coalesce(k, 0) / n, 6) AS recall FROM sz LEFT JOIN ht ON ht.u = sz.u""")
def holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = C.holdout(T.consumed(spark, sf_dir).withColumn("eligible", F.col("is_primary")))
    held = split.filter("held").select("user", "event")
    left = T.consumed(spark, sf_dir).select("user", "event").join(held, ["user", "event"], "left_anti")
    top = left.groupBy("event").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "event").limit(10)
    rec = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("c"), "event"))).select("event", "rank")
    ranked = held.select("user").distinct().crossJoin(F.broadcast(rec))  # ten rows
    m = C.ranking_metrics(ranked, held)
    return m.select("user", F.round("ndcg", 6).alias("ndcg"), "hit", F.round("recall", 6).alias("recall"))


_GRID = _HOLD.replace("seen", "pool") + ", seen AS (SELECT pool.* FROM pool SEMI JOIN held x ON x.u = pool.u ANTI JOIN held y ON y.u = pool.u AND y.e = pool.e)" + _PEERS + _CBF + """, cand AS (SELECT coalesce(best.u, cb.u) AS u, coalesce(best.e, cb.e) AS e, coalesce(cbf, 0) AS cbf, coalesce(cf, 0) AS cf FROM best FULL JOIN cb ON best.u = cb.u AND best.e = cb.e),
g AS (SELECT CAST(i / 10.0 AS DOUBLE) AS alpha FROM generate_series(0, 10) t(i)),
gr AS (SELECT alpha, u, e, p_brand, round(alpha * cbf + (1 - alpha) * cf, 9) AS score FROM cand JOIN part ON p_partkey = e, g),
ig AS (SELECT *, row_number() OVER (PARTITION BY alpha, u, p_brand ORDER BY score DESC, e) AS ig FROM gr), kp AS (SELECT *, count(*) FILTER (WHERE ig = 1) OVER (PARTITION BY alpha, u) AS groups FROM ig),
rk AS (SELECT alpha, u, e, row_number() OVER (PARTITION BY alpha, u ORDER BY score DESC, e) AS rank FROM kp WHERE ig = 1 OR groups < 10 QUALIFY rank <= 10),
ht AS (SELECT alpha, rk.u, sum(1 / log2(rank + 1)) AS dcg, count(*) AS k FROM rk JOIN held ON held.u = rk.u AND held.e = rk.e GROUP BY 1, 2), sz AS (SELECT u, count(*) AS n FROM held GROUP BY 1),
pu AS (SELECT g.alpha, coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, least(n, 10)), lambda i: 1 / log2(i + 1))) AS ndcg, CAST(coalesce(k, 0) > 0 AS DOUBLE) AS hit, coalesce(k, 0) / n AS recall FROM sz CROSS JOIN g LEFT JOIN ht ON ht.u = sz.u AND ht.alpha = g.alpha),
m AS (SELECT alpha, avg(ndcg) AS ndcg, avg(hit) AS hit, avg(recall) AS recall FROM pu GROUP BY 1)
"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.retune(_history(spark, sf_dir), _event_vectors(spark, sf_dir), T.events(spark, sf_dir).select("event", "story"), F.lit(AS_OF).cast("timestamp_ntz"), 300.0)


@register("retune_grid", _GRID + "SELECT alpha, round(ndcg, 6) AS ndcg, round(hit, 6) AS hit, round(recall, 6) AS recall FROM m")
def retune_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("alpha", *[F.round(c, 6).alias(c) for c in ("ndcg", "hit", "recall")])


@register("weight_grid_argmax", _GRID + """, b AS (SELECT * FROM m ORDER BY round(ndcg, 12) DESC, abs(round(alpha - 0.7, 9)), alpha LIMIT 1)
SELECT round(least(greatest(CASE WHEN ndcg = 0 THEN 0.7 ELSE alpha END, 0.6), 0.8), 4) AS alpha, round(ndcg, 6) AS ndcg FROM b""")
def weight_grid_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.choose_weight(_grid(spark, sf_dir).select("alpha", "ndcg"), current=0.7).withColumn("ndcg", F.round("ndcg", 6))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"), "lang")
    return T.table(spark, sf_dir, "labels").join(d, "doc_id").select("score", (F.col("quality") == 1).alias("label"), "lang")


_CURVE = """WITH s AS (SELECT CAST(n_chars AS DOUBLE) AS score, CAST(quality = 1 AS INT) AS p, CAST(quality <> 1 AS INT) AS n FROM labels JOIN documents USING (doc_id)), b AS (SELECT score, sum(p) AS p, sum(n) AS n FROM s GROUP BY 1),
c AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM b WINDOW w AS (ORDER BY score DESC)),
r AS (SELECT *, tp / (tp + fp) AS precision, tp / pos AS recall, coalesce(lag(tp) OVER (ORDER BY score DESC), 0) AS ptp, coalesce(lag(fp) OVER (ORDER BY score DESC), 0) AS pfp FROM c)
"""


@register("average_precision", _CURVE + "SELECT round(sum(precision * (recall - ptp / pos)), 6) AS average_precision FROM r")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.average_precision(_scored(spark, sf_dir)).select(F.round("average_precision", 6).alias("average_precision"))


@register("average_precision_missed", _CURVE + "SELECT round(sum(precision * (tp - ptp) / (pos + 25)), 6) AS average_precision FROM r")
def average_precision_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.average_precision(_scored(spark, sf_dir), missed=25).select(F.round("average_precision", 6).alias("average_precision"))


@register("roc_auc", _CURVE + "SELECT round(sum((fp - pfp) * (tp + ptp) / 2.0) / (max(pos) * max(neg)), 6) AS roc_auc FROM r")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.roc_auc(_scored(spark, sf_dir)).select(F.round("roc_auc", 6).alias("roc_auc"))


@register("fbeta_threshold", _CURVE + ", f AS (SELECT score AS threshold, coalesce(1.25 * precision * recall / nullif(0.25 * precision + recall, 0), 0) AS f, precision, recall FROM r) SELECT threshold, round(f, 6) AS f, round(precision, 6) AS precision, round(recall, 6) AS recall FROM f ORDER BY round(f.f, 12) DESC, f.recall DESC, f.precision DESC, threshold DESC LIMIT 1")
def fbeta_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = E.best_threshold(_scored(spark, sf_dir))
    return b.select("threshold", *[F.round(c, 6).alias(c) for c in ("f", "precision", "recall")])


@register("threshold_replay", _CURVE + """, t AS (SELECT i * 500.0 AS threshold FROM generate_series(0, 20) g(i)), x AS (SELECT CAST(threshold AS DOUBLE) AS threshold, (SELECT sum(p) FROM s WHERE score >= threshold) AS tp, (SELECT sum(n) FROM s WHERE score >= threshold) AS fp, (SELECT sum(p) FROM s) AS pos FROM t)
SELECT threshold, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / pos, 0), 6) AS recall FROM x""")
def threshold_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.replay(_scored(spark, sf_dir), spark.range(21).select((F.col("id") * 500.0).alias("threshold")))
    return r.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@register("macro_micro_f1", """WITH p AS (SELECT lang, CAST(sum(CAST(n_chars >= 1000 AND quality = 1 AS INT)) AS DOUBLE) AS tp, CAST(sum(CAST(n_chars >= 1000 AND quality <> 1 AS INT)) AS DOUBLE) AS fp, CAST(sum(CAST(n_chars < 1000 AND quality = 1 AS INT)) AS DOUBLE) AS fn FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1 FROM p""")
def macro_micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.macro_micro(_scored(spark, sf_dir), 1000.0, "lang")
    return m.select(F.round("micro_f1", 6).alias("micro_f1"), F.round("macro_f1", 6).alias("macro_f1"))


@register("exact_match_prf", """WITH p AS (SELECT DISTINCT l_orderkey AS a, l_suppkey AS b FROM lineitem WHERE l_discount >= 0.03), g AS (SELECT DISTINCT l_orderkey AS a, l_suppkey AS b FROM lineitem WHERE l_tax <= 0.05),
c AS (SELECT count(*) FILTER (WHERE p.a IS NOT NULL AND g.a IS NOT NULL) AS tp, count(*) FILTER (WHERE g.a IS NULL) AS fp, count(*) FILTER (WHERE p.a IS NULL) AS fn FROM p FULL JOIN g ON p.a = g.a AND p.b = g.b)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def exact_match_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b"), "l_discount", "l_tax")
    m = E.exact_match(li.filter("l_discount >= 0.03"), li.filter("l_tax <= 0.05"), ["a", "b"])
    return m.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
