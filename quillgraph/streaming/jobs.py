"""Incremental forms: sliding trend windows, read state by idempotent batches, moving centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import state


def sliding_counts(log: DataFrame, at: str = "ts", key: str = "event_type", late: str = "1 hour") -> DataFrame:
    """Counts per key over the last 24 hours, every 12 (05:00 and 17:00); as a stream, rows later than ``late`` are left out."""
    source = log.withWatermark(at, late) if log.isStreaming else log
    w = F.window(F.col(at).cast("timestamp"), "24 hours", "12 hours", "5 hours")
    return source.groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "n")


def keep_read_state(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Folds a stream of reads (user, item, at) into a table at path/batch=<n>; a batch that is run again writes the same."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = state.read_state(batch)
        if number:
            new = state.merge_state(spark.read.parquet(f"{path}/batch={number - 1}"), new)
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def moving_centroids(members: DataFrame, keep: float = 0.15) -> DataFrame:
    """(event, n, embedding) after each micro-batch: every member moves its event's centroid, in order of seq within the batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        n, centre = held.get if held.exists else (0, None)
        rows = pd.concat(list(frames)).sort_values("seq")
        centre = None if centre is None else np.asarray(centre, float)
        for v in rows["embedding"]:
            v = np.asarray(v, float)
            mixed = v if centre is None else centre * (1 - keep) + v * keep
            centre = mixed / (np.linalg.norm(mixed) or 1.0)
            n += 1
        held.update((int(n), centre.tolist()))
        yield pd.DataFrame({"event": [key[0]], "n": [int(n)], "embedding": [centre.tolist()]})

    return members.groupBy("event").applyInPandasWithState(step, "event long, n long, embedding array<double>", "n long, embedding array<double>", "update", GroupStateTimeout.NoTimeout)
