"""Evaluation over score tables (score, label BOOLEAN), tie-invariant and without per-row loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def curve(scored: DataFrame, missed: int = 0) -> DataFrame:
    """(score, tp, fp, positives, negatives, precision, recall) after each distinct score from the top; missed positives only add to recall's base."""
    by = scored.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum((~F.col("label")).cast("long")).alias("n"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = by.select("score", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), (F.sum("p").over(every) + missed).alias("positives"), F.sum("n").over(every).alias("negatives"))
    return out.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("recall", F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0))


def average_precision(scored: DataFrame, missed: int = 0) -> DataFrame:
    """(average_precision): sum of precision times recall gained at each distinct score."""
    gained = F.col("recall") - F.coalesce(F.lag("recall").over(Window.orderBy(F.desc("score"))), F.lit(0.0))
    return curve(scored, missed).select((F.col("precision") * gained).alias("g")).agg(F.coalesce(F.sum("g"), F.lit(0.0)).alias("average_precision"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """(roc_auc): positives above negatives, a tie counting half; null without both kinds."""
    w = Window.orderBy(F.desc("score"))
    c = curve(scored).withColumn("ptp", F.coalesce(F.lag("tp").over(w), F.lit(0))).withColumn("pfp", F.coalesce(F.lag("fp").over(w), F.lit(0)))
    area = F.sum((F.col("fp") - F.col("pfp")) * (F.col("tp") + F.col("ptp")) / 2.0)
    return c.agg((area / F.nullif(F.max("positives") * F.max("negatives"), F.lit(0))).alias("roc_auc"))


def best_threshold(scored: DataFrame, beta: float = 0.5) -> DataFrame:
    """(threshold, f, precision, recall) of the score with the best F-beta; ties by recall, precision, threshold."""
    b = beta * beta
    f = (1 + b) * F.col("precision") * F.col("recall") / F.nullif(b * F.col("precision") + F.col("recall"), F.lit(0.0))
    c = curve(scored).withColumn("f", F.coalesce(f, F.lit(0.0)))
    best = c.agg(F.max_by(F.struct("score", "f", "precision", "recall"), F.struct(F.round("f", 12), "recall", "precision", "score")).alias("b"))
    return best.select(F.col("b.score").alias("threshold"), "b.f", "b.precision", "b.recall")


def replay(scored: DataFrame, thresholds: DataFrame, beta: float = 0.5) -> DataFrame:
    """(threshold, precision, recall, f) of each given threshold: one pass, no rows per threshold and score."""
    marks = thresholds.select(F.col("threshold").cast("double").alias("score"), F.lit(True).alias("mark"), F.lit(0).alias("p"), F.lit(0).alias("n"))
    by = scored.groupBy(F.col("score").cast("double").alias("score")).agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum((~F.col("label")).cast("long")).alias("n")).withColumn("mark", F.lit(False))
    w = Window.orderBy(F.desc("score"), "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = by.unionByName(marks).select("score", "mark", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"), F.sum("p").over(every).alias("pos")).filter("mark")
    b = beta * beta
    p, r = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0)), F.coalesce(F.col("tp") / F.nullif("pos", F.lit(0)), F.lit(0.0))
    out = run.select(F.col("score").alias("threshold"), p.alias("precision"), r.alias("recall"))
    return out.withColumn("f", F.coalesce((1 + b) * F.col("precision") * F.col("recall") / F.nullif(b * F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def exact_match(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of two sets of keys."""
    a, b = predicted.select(*keys).distinct().withColumn("in_p", F.lit(1)), gold.select(*keys).distinct().withColumn("in_g", F.lit(1))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    p, g = F.col("in_p").isNotNull(), F.col("in_g").isNotNull()
    out = a.join(b, keys, "full_outer").agg(n(p & g).alias("tp"), n(p & ~g).alias("fp"), n(~p & g).alias("fn"))
    rate = lambda x, y: F.coalesce(F.col("tp") / F.nullif(F.col(x) + F.col(y), F.lit(0)), F.lit(0.0))
    out = out.withColumn("precision", rate("tp", "fp")).withColumn("recall", rate("tp", "fn"))
    return out.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def macro_micro(scored: DataFrame, threshold: float, group: str) -> DataFrame:
    """(micro_f1, macro_f1): F1 pooled over all rows, and its mean over groups."""
    hit, lab = F.col("score") >= threshold, F.col("label")
    per = scored.groupBy(group).agg(*[F.sum(x.cast("long")).alias(n) for n, x in (("tp", hit & lab), ("fp", hit & ~lab), ("fn", ~hit & lab))])
    f1 = lambda a, b, c: F.coalesce(2 * a / F.nullif(2 * a + b + c, F.lit(0)), F.lit(0.0))
    return per.agg(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"), F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"))


def pair_order(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """(pairs, ordered, accuracy): share of (better, worse) pairs whose better one scores strictly higher."""
    a, b = scores.withColumnsRenamed({"id": "better", "score": "sb"}), scores.withColumnsRenamed({"id": "worse", "score": "sw"})
    out = pairs.join(a, "better").join(b, "worse").agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum((F.col("sb") > F.col("sw")).cast("long")), F.lit(0)).alias("ordered"))
    return out.withColumn("accuracy", F.coalesce(F.col("ordered") / F.nullif("pairs", F.lit(0)), F.lit(0.0)))


def early_stop(history: DataFrame, patience: int) -> DataFrame:
    """history (epoch, metric) with best_so_far and stop: no new best for ``patience`` epochs."""
    w = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max_by("epoch", F.struct("metric", -F.col("epoch"))).over(w)
    return history.withColumn("best_so_far", F.max("metric").over(w)).withColumn("stop", F.col("epoch") - best >= patience)
