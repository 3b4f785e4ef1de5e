"""Graph, snapshot and manifest writers over Parquet and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_bundle(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """nodes/ and edges/ as JSON lines, and the manifest (part, name, n), written too."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    by_label = nodes.select(F.lit("label").alias("part"), F.explode("labels").alias("name")).groupBy("part", "name").agg(F.count(F.lit(1)).alias("n"))
    by_type = edges.groupBy(F.lit("edge").alias("part"), F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    manifest = by_label.unionByName(by_type)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def load_rows(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text in ``<name>_json``; scalars stay."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f"{f.name}_json") if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def replace_snapshot(df: DataFrame, path: str, column: str = "snapshot_at") -> bool:
    """Replaces the snapshots that df holds, in whole; an empty df replaces nothing (returns False)."""
    if not df.limit(1).count():
        return False
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    return True


def purge(df: DataFrame, column: str, as_of: str, days: int = 7) -> DataFrame:
    """Rows not older than the retention."""
    return df.filter(F.col(column) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left of a resumed job."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
