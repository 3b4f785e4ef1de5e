"""Joins whose hot keys don't land in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task may get, and most keys above it that are broadcast; the first grows where the second would be passed.
ROWS, KEYS = 4096, 50_000


def spread_lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows left-joined with table, which has one row a key and in ``weight`` how many of the ``total`` rows have it.

    Keys of more than a limit of rows, total / limit keys at most, are looked
    up in a broadcast; their rows, and those with a null key, go through the
    shuffle by a hash of their own columns and partition, so that no task gets
    more than its share.
    """
    limit = max(ROWS, total // KEYS)
    values = [c for c in table.columns if c not in (key, weight)]
    table = table.withColumnRenamed(key, "__k")
    if total <= limit:
        return rows.join(table.drop(weight), rows[key] == F.col("__k"), "left").drop("__k")
    hot = table.filter(F.col(weight) > limit).select(F.col("__k").alias("__hk"), F.struct(*values).alias("__hot"))
    marked = rows.join(F.broadcast(hot), rows[key] == F.col("__hk"), "left")
    # rows that are dealt out may meet another key's row by chance, which counts for nothing
    plain = F.col("__hk").isNull() & F.col(key).isNotNull()
    marked = marked.withColumn("__plain", plain).withColumn("__at", F.when(plain, F.col(key)).otherwise(F.xxhash64(*rows.columns, F.spark_partition_id())))
    cold = table.select("__k", F.struct(*values).alias("__cold"))
    out = marked.join(cold, F.col("__at") == F.col("__k"), "left")
    found = F.when(F.col("__plain"), F.col("__cold")).otherwise(F.col("__hot"))
    return out.select(*rows.columns, *[found[v].alias(v) for v in values])
