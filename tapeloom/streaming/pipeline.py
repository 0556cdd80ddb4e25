"""Incremental work as Structured Streaming.

Each ``foreachBatch`` step is safe to replay: outputs are keyed by batch id or
by row key, so running a batch twice leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from tapeloom.operators.validate import Rule, accepted, rejected, validate


def read_shards(spark: SparkSession, path: str, schema, files_per_batch: int = 4) -> DataFrame:
    """A folder of Parquet shards as a stream, a few files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, rules: Callable[[DataFrame], list[Rule]], align: Callable[[DataFrame], DataFrame], out: str, quarantine: str, checkpoint: str,
           table: str = "table", source: str = "source") -> StreamingQuery:
    """align, validate, split, write; then stop when all that is there has been read.

    A batch overwrites its own partition ``batch``, so a replay changes nothing.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        rows = align(batch)
        checked = validate(rows, rules(rows)).persist()
        try:
            for frame, path in ((accepted(checked), out), (rejected(checked, str(batch_id), table, source), quarantine)):
                (frame.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))
        finally:
            checked.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bars_from_ticks(stream: DataFrame, width: str = "1 day", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Bars per code and event-time window; rows later than ``late`` are dropped once a window is closed.

    The same plan runs on a batch table, where nothing is late.
    """
    rows = stream.withWatermark("ts", late) if stream.isStreaming else stream
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    order = F.struct("ts", "id")
    agg = rows.groupBy("code", w.alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("n"))
    return agg.select("code", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "n")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Activity sessions per code, closed by a gap."""
    rows = stream.withWatermark("ts", late) if stream.isStreaming else stream
    agg = rows.groupBy("code", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("price").alias("total"))
    return agg.select("code", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def deduplicated(stream: DataFrame, keys: list[str], late: str = "2 hours", time: str = "ts") -> DataFrame:
    """First row per key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)


def observe_factors(stream: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Latest factor and revision count per (code, day), one row for every new or moved value.

    Values of a key within one batch are taken in order of ``seq``.
    """
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, revision = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for factor in rows["factor"]:
            if value is None or abs(factor - value) > tolerance:
                revision += 1
                out.append((*key, float(factor), revision, value is not None))
                value = float(factor)
        state.update((value, revision))
        yield pd.DataFrame(out, columns=["code", "day", "factor", "revision_no", "alert"])

    return stream.groupBy("code", "day").applyInPandasWithState(update, "code string, day string, factor double, revision_no int, alert boolean", "value double, revision int", "append", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what a stream has now to Parquet and wait for it."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
