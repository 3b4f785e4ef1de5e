"""Filters with optional parameters, item checks, id lookups, cursors, aliases and small state changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def optional_in(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Rows whose column is one of values; none given, or an empty list, filters nothing."""
    return df.filter(F.col(column).isin(list(values))) if values else df


def claimable(queue: DataFrame, most: int) -> DataFrame:
    """Work still to be done: in processing, without a node, and tried fewer than ``most`` times (null: never)."""
    return queue.filter((F.col("status") == "PROCESSING") & F.col("node").isNull() & (F.coalesce("attempts", F.lit(0)) < most))


def valid_items(items: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Items (user, event, rank, kind, score) with all fields and a known kind; of those that share an event, and then a rank, of a user the first by (rank, event)."""
    whole = items.dropna(subset=["user", "event", "rank", "kind", "score"]).filter(F.col("kind").isin(list(kinds)))
    by_event = Window.partitionBy("user", "event").orderBy("rank", F.desc("score"), "kind")
    by_rank = Window.partitionBy("user", "rank").orderBy("event")
    once = whole.withColumn("__n", F.row_number().over(by_event)).filter("__n = 1")
    return once.withColumn("__n", F.row_number().over(by_rank)).filter("__n = 1").drop("__n")


def first_label(labels: Column, known: Sequence[str]) -> Column:
    """The first of a node's labels that is a known one; null without."""
    return F.get(F.filter(labels, lambda x: x.isin(list(known))), F.lit(0))


def label_array(main: str, extra: Column) -> Column:
    """The main label, and the extra one where there is one."""
    return F.array_compact(F.array(F.lit(main), extra))


def add_alias(aliases: Column, name: Column, title: Column) -> Column:
    """aliases (null: none) with name at the end, unless it is null, the title, or there already."""
    own = F.coalesce(aliases, F.array().cast("array<string>"))
    known = name.isNull() | (name == title) | F.array_contains(own, name)
    return F.when(F.coalesce(known, F.lit(False)), own).otherwise(F.array_append(own, name))


def fetch_in_order(asked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows that asked (key, rank) names, with the rank; ids without a row are passed over."""
    return asked.join(rows, key)


def article_subgraph(links: DataFrame, covers: DataFrame, primary_only: bool = False) -> DataFrame:
    """(article, src, dst): an article's own links and those of the events it covers (its primary ones on demand), each once.

    links: (src, dst), where an article is a node like others; covers: (article, event, is_primary).
    """
    told = covers.filter("is_primary") if primary_only else covers
    nodes = told.select("article", F.col("article").alias("src")).union(told.select("article", F.col("event").alias("src"))).distinct()
    return nodes.join(links, "src").select("article", "src", "dst").distinct()


def encode_cursor(*parts: Column, version: int = 1) -> Column:
    """Opaque url-safe text of a page's last key: version and parts, none of which holds a line feed."""
    text = F.concat_ws("\n", F.lit(str(version)), *[p.cast("string") for p in parts])
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/=\r\n", "-_"), F.lit("="))


def decode_cursor(cursor: Column, size: int, version: int = 1) -> Column:
    """The parts of a cursor; null where it has another version or number of parts."""
    plain = F.translate(cursor, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    parts = F.split(F.decode(F.unbase64(padded), "UTF-8"), "\n")
    return F.when((F.size(parts) == size + 1) & (parts[0] == str(version)), F.slice(parts, 2, size))


def claim(rows: DataFrame, owner: str, now: Column) -> DataFrame:
    """Compare and set: rows that are free or whose lease is over by ``now`` get the owner and are told apart by ``won``."""
    free = F.col("owner").isNull() | (F.col("lease") < now)
    return rows.withColumn("won", F.coalesce(free, F.lit(False))).withColumn("owner", F.when(F.col("won"), F.lit(owner)).otherwise(F.col("owner")))


def set_difference(have: DataFrame, want: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change): ADD for distinct wanted rows that exist (by the last key among known) and aren't there, REMOVE for those that aren't wanted."""
    real = want.select(*keys).distinct().join(known.select(keys[-1]).distinct(), keys[-1], "left_semi")
    add = real.join(have, list(keys), "left_anti").select(*keys, F.lit("ADD").alias("change"))
    return add.unionByName(have.select(*keys).join(real, list(keys), "left_anti").select(*keys, F.lit("REMOVE").alias("change")))


def resolve_organization(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(domain, name, org, is_new) of every distinct asked (domain, name): known by domain, else by name (the least org), else a new id from both."""
    by_domain = known.groupBy("domain").agg(F.min("org").alias("__d"))
    by_name = known.groupBy("name").agg(F.min("org").alias("__n"))
    out = asked.select("domain", "name").distinct().join(by_domain, "domain", "left").join(by_name, "name", "left")
    new = F.substring(F.sha2(F.concat_ws("\n", F.coalesce("domain", F.lit("")), F.coalesce("name", F.lit(""))), 256), 1, 16)
    found = F.coalesce("__d", "__n")
    return out.select("domain", "name", F.coalesce(found.cast("string"), new).alias("org"), found.isNull().alias("is_new"))


def mean_softmax(logits: DataFrame) -> DataFrame:
    """(item, label, p): the mean over an item's windows of each window's softmax; logits has (item, window, label, logit)."""
    top = Window.partitionBy("item", "window")
    e = logits.withColumn("__e", F.exp(F.col("logit") - F.max("logit").over(top)))
    return e.withColumn("__p", F.col("__e") / F.sum("__e").over(top)).groupBy("item", "label").agg(F.avg("__p").alias("p"))


def two_labels(p: DataFrame, least: float) -> DataFrame:
    """(item, label, second): the likeliest label, and the next if it reaches ``least``; ties by label."""
    n = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("p"), "label"))
    r = p.withColumn("__n", n).filter("__n <= 2")
    second = F.max(F.when((F.col("__n") == 2) & (F.col("p") >= least), F.col("label")))
    return r.groupBy("item").agg(F.max(F.when(F.col("__n") == 1, F.col("label"))).alias("label"), second.alias("second"))
