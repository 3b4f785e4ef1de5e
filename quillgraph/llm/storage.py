"""Shared-folder tables that cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver imported it from, whatever their working folder."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and Spark runs on this machine alone, a new folder of it."""
    conf = spark.sparkContext.getConf()
    at = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not at:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Tables of one operator run in the shared folder.  ``keep`` writes and rereads a frame; ``drop`` deletes one that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        atexit.register(self._clear)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def _clear(self) -> None:
        """What is left goes when the driver ends."""
        with contextlib.suppress(Exception):  # the session may be gone
            self.drop()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
