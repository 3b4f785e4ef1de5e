"""State tables as keyed rebuilds: upserts, replace-sets, snapshots, state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_state(log: DataFrame) -> DataFrame:
    """(user, item, first_at, last_at, clicks) of a read log (user, item, at)."""
    return log.groupBy("user", "item").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("clicks"))


def merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two read states as one: times widen, clicks add up."""
    return old.unionByName(new).groupBy("user", "item").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("clicks").alias("clicks"))


def knowledge_nodes(reads: DataFrame) -> DataFrame:
    """(user, node, read_articles, primary_reads, first_seen, last_seen) of reads (user, node, article, is_primary, at)."""
    return reads.groupBy("user", "node").agg(
        F.count_distinct("article").alias("read_articles"), F.count_distinct(F.when(F.col("is_primary"), F.col("article"))).alias("primary_reads"),
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"),
    )


def insert_absent(stored: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows of new to append: keys that stored lacks, the first of each by order."""
    w = Window.partitionBy(key).orderBy(order)
    return new.join(stored.select(key), key, "left_anti").withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with new's rows in place of those of equal keys."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def replace_set(stored: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action): DELETE what isn't wanted, ADD what isn't stored, KEEP the rest."""
    a, b = stored.select(*keys).distinct().withColumn("__s", F.lit(1)), wanted.select(*keys).distinct().withColumn("__w", F.lit(1))
    action = F.when(F.col("__w").isNull(), "DELETE").when(F.col("__s").isNull(), "ADD").otherwise("KEEP")
    return a.join(b, keys, "full_outer").select(*keys, action.alias("action"))


def valid_users(requested: DataFrame, known: DataFrame) -> DataFrame:
    """(user, ok): whether all requested (user, node) exist; one user's failure leaves the others alone."""
    found = requested.join(known.select("node").distinct().withColumn("__k", F.lit(1)), "node", "left")
    return found.groupBy("user").agg(F.bool_and(F.col("__k").isNotNull()).alias("ok"))


def fresh_only(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming (user, aggregated_at, ...) without users whose stored updated_at isn't older."""
    return incoming.join(stored.select("user", "updated_at"), "user", "left").filter("updated_at is null or aggregated_at > updated_at").drop("updated_at")


def analysis_transition(articles: DataFrame, outcomes: DataFrame, most: int = 3) -> DataFrame:
    """articles (article, status, attempts) after outcomes (article, outcome): only PROCESSING rows move; the last failed attempt is FAILED."""
    out = articles.join(outcomes, "article", "left")
    moves = (F.col("status") == "PROCESSING") & F.col("outcome").isNotNull()
    failed = moves & (F.col("outcome") == "ERROR")
    status = F.when(moves & (F.col("outcome") == "OK"), "COMPLETED").when(moves & (F.col("outcome") == "DROP"), "DROPPED").when(failed & (F.col("attempts") + 1 >= most), "FAILED").otherwise(F.col("status"))
    return out.select("article", status.alias("status"), F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"))


def stop_after_failures(runs: DataFrame, limit: int = 5) -> DataFrame:
    """runs (batch, seq, ok) up to and with the one that makes ``limit`` failures in a row."""
    w = Window.partitionBy("batch").orderBy("seq")
    island = runs.withColumn("__g", F.sum(F.col("ok").cast("int")).over(w))
    streak = island.withColumn("__f", F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("batch", "__g").orderBy("seq")))
    stop = F.min(F.when(F.col("__f") >= limit, F.col("seq"))).over(Window.partitionBy("batch"))
    return streak.withColumn("__s", stop).filter("__s is null or seq <= __s").drop("__g", "__f", "__s")


def latest_visible(snapshots: DataFrame, as_of: Column, by: list[str] | None = None) -> DataFrame:
    """Rows of the newest snapshot_at not after as_of (per group)."""
    seen = snapshots.filter(F.col("snapshot_at") <= as_of)
    if not by:
        return seen.join(seen.agg(F.max("snapshot_at").alias("snapshot_at")), "snapshot_at")
    return seen.join(seen.groupBy(*by).agg(F.max("snapshot_at").alias("snapshot_at")), [*by, "snapshot_at"])


def roll_up(chunks: DataFrame) -> DataFrame:
    """(run, succeeded, failed, status) of chunk results (run, succeeded, failed)."""
    s = chunks.groupBy("run").agg(F.sum("succeeded").alias("succeeded"), F.sum("failed").alias("failed"))
    return s.withColumn("status", F.when(F.col("failed") == 0, "COMPLETED").when(F.col("succeeded") == 0, "FAILED").otherwise("PARTIAL"))


def titles(stored: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """(event, title, event_updated_at): updated_at moves only where the title changes or is new."""
    a = stored.withColumnsRenamed({"title": "__t", "event_updated_at": "__u"})
    return a.join(incoming, "event", "full_outer").select("event", F.coalesce("title", "__t").alias("title"), F.when(F.col("title").isNotNull() & ~F.col("title").eqNullSafe(F.col("__t")), now).otherwise(F.col("__u")).alias("event_updated_at"))


def stale_summaries(events: DataFrame) -> DataFrame:
    """Events without a summary, or updated after it was made."""
    return events.filter("summary is null or (event_updated_at is not null and (summary_generated_at is null or event_updated_at > summary_generated_at))")


def keyset_page(df: DataFrame, order: list[tuple[str, bool]], after: dict | None, size: int) -> DataFrame:
    """size + 1 rows after the cursor by (column, descending) keys; the extra row tells that more follow."""
    if after:
        past, tied = F.lit(False), F.lit(True)
        for c, down in order:
            past = past | (tied & ((F.col(c) < F.lit(after[c])) if down else (F.col(c) > F.lit(after[c]))))
            tied = tied & (F.col(c) == F.lit(after[c]))
        df = df.filter(past)
    return df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).limit(size + 1)
