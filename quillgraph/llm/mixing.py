"""Mixing sources to target weights.

Tokens (here: words) are summed per source; each source gets a target by
weight, capped at a multiple of its size with the excess shared anew; the
target over the size is its repetition rate.  A document is emitted
floor(rate) times, plus one hash-seeded Bernoulli copy with the rate's
fraction as probability, so no shuffle of documents is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

#: Tables of sources and of shared ids are broadcast up to this many rows, and joined by a shuffle beyond.
MANY = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighted_sources(sizes: DataFrame, weights: Sequence[int], scratch: Scratch) -> DataFrame:
    """(source, source_size, weight): weights repeat over the sources by code point, null last.

    Sources are dealt to tasks in order; each task's share is numbered by
    itself, and the shares' sizes, one row a task, are summed up.
    """
    order = F.col("source").asc_nulls_last()
    dealt = scratch.keep(sizes.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranked")
    run = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    offs = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__off", F.coalesce(F.sum("__n").over(run), F.lit(0))).drop("__n")
    ranked = dealt.withColumn("__rn", F.row_number().over(Window.partitionBy("__part").orderBy(order))).join(F.broadcast(offs), "__part")
    w = F.array(*[F.lit(int(x)) for x in weights])
    return ranked.select("source", "source_size", F.element_at(w, (F.pmod(F.col("__rn") + F.col("__off") - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight"))


def _draws(docs: DataFrame, scratch: Scratch, seed: str) -> DataFrame:
    """docs with __draw in [0, 1), by doc_id and seed; rows that share a doc_id draw by their text and their number among equals too.

    Only rows of shared ids are shuffled.  Equal rows are numbered task by
    task, so a rerun gives the same draws to the same rows.
    """
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = lambda key: F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    shared = scratch.keep(docs.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1"), "shared")
    n = shared.count()
    if not n:
        return docs.withColumn("__draw", drawn(own))
    shared = F.broadcast(shared.select("__id")) if n <= MANY else shared.select("__id")
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    lone = docs.join(shared, same, "left_anti").withColumn("__draw", drawn(own))
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    many = scratch.keep(docs.join(shared, same, "left_semi").withColumn("__th", text).withColumn("__part", F.spark_partition_id()), "repeated")
    parts = many.groupBy("doc_id", "__th", "__part").agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy("doc_id", "__th").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    parts = parts.select(F.col("doc_id").alias("__id"), F.col("__th").alias("__t"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__off"))
    within = Window.partitionBy("doc_id", "__th", "__part").orderBy("source")
    numbered = many.withColumn("__rn", F.row_number().over(within)).join(parts, same & (F.col("__th") == F.col("__t")) & (F.col("__part") == F.col("__p")))
    key = F.concat_ws(":", own, "__th", (F.col("__rn") + F.col("__off")).cast("string"))
    return lone.unionByName(numbered.withColumn("__draw", drawn(key)).select(*lone.columns))


def water_level(sources: DataFrame, share: float, cap: int) -> float:
    """The level L at which sum(min(cap * size, weight * L)) = share * total size.

    Each round fixes the sources whose part exceeds their cap and shares the
    rest by weight, until none is above; only three sums reach the driver.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    level = -1.0
    while True:
        over = F.col("weight") * F.lit(level) >= F.col("source_size") * cap if level >= 0 else F.lit(False)
        row = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("source_size") * cap)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("w"),
        ).first()
        if not row["w"]:
            return level
        new = (share * total - row["full"]) / row["w"]
        if new <= level:
            return level
        level = new


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """Documents with size, source_size, target, rate and copies (how often the mix takes the document).

    A null text has size 0.  A null source is a source of its own.  A document
    draws by its doc_id and seed; rows that share a doc_id (or have none) draw
    by their text and number too, so repeated rows draw apart.  A source of
    size 0 has target 0 and no copies.  An empty table gives no rows.  Columns
    of the input that clash with the added ones are replaced.
    """
    added = ("size", "source_size", "target", "rate", "copies", "weight")
    docs = docs.drop(*[c for c in docs.columns if c in added]).withColumn("size", word_count(F.col("text")))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source: written once, so that the rounds below don't read the documents again
    scratch = Scratch(docs.sparkSession, "mix")
    sources = scratch.keep(weighted_sources(sizes, weights, scratch), "sources")
    few = sources.count() <= MANY
    level = water_level(sources, share, cap)
    sources = sources.withColumn("target", F.least((F.col("source_size") * cap).cast("double"), F.col("weight") * F.lit(level))).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )
    docs = _draws(docs, scratch, seed)  # before the join, so that the text needn't go through its shuffle
    right = sources.select(F.col("source").alias("__s"), "source_size", "target", "rate")
    whole = F.floor("rate")
    return (
        docs.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("__s")), "left")
        .drop("__s")
        .withColumn("copies", (whole + (F.col("__draw") < F.col("rate") - whole).cast("int")).cast("long"))
        .drop("__draw")
    )


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy that the mix takes, with copy_no from 0."""
    return mixed.filter("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
