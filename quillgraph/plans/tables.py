"""Driver tables read as the article graph they stand in for.

article = orders, event = part (story: p_brand, topic: p_type), COVERS =
lineitem (primary: l_linenumber = 1, confidence: 1 - l_discount), entity =
supplier, user = customer, log = events (node: props.k).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article, event, place, is_primary, confidence, published_at, user)"""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article"), F.col("o_orderdate").alias("published_at"), F.col("o_custkey").alias("user"))
    c = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("article"), F.col("l_partkey").alias("event"), F.col("l_linenumber").alias("place"),
        (F.col("l_linenumber") == 1).alias("is_primary"), (1 - F.col("l_discount")).alias("confidence"),
    )
    return c.join(o, "article")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("event"), F.col("p_name").alias("title"), F.col("p_brand").alias("story"), F.col("p_type").alias("topic"))


def consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, event, is_primary, clicks, last_viewed_at): primary events are those that some article covers as its first."""
    c = covers(spark, sf_dir).repartition("event")  # the one shuffle of what follows
    per = c.groupBy("user", "event").agg(F.count(F.lit(1)).alias("clicks"), F.max("published_at").alias("last_viewed_at"), F.coalesce(F.bool_or("is_primary"), F.lit(False)).alias("p"))
    return per.select("user", "event", F.max("p").over(Window.partitionBy("event")).alias("is_primary"), "clicks", "last_viewed_at")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user, at, kind, value, node)"""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("user"), F.col("ts").alias("at"), F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("int").alias("node"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part edges of the COVERS rows, one per pair, the largest confidence."""
    new = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.lit("MENTIONS").alias("type"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"),
        (1 - F.col("l_discount")).alias("confidence"), (F.col("l_linenumber") == 1).alias("is_primary"), F.col("l_shipdate").alias("created_at"),
    )
    return graph.merge_edges(new.limit(0), new).withColumn("edge_id", F.concat_ws(">", "src", "dst"))
