"""Shards in two passes, and micro-batches merged into a table by key.

Every step of a stream here can be run again: pass results are partitions named by batch id, and a merge by
key gives the same table however often a batch is merged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tapeloom.operators import adjust
from tapeloom.operators.ingest import upsert
from tapeloom.operators.kernels import latest_per_key
from tapeloom.sources.export import write_partitions


def _each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    write_partitions(rows.withColumn("batch", F.lit(batch_id)), path, "batch")


def fold_factors(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """First pass: of every shard the factors (code, day, factor), one per key, as a partition of ``table``."""
    def step(batch: DataFrame, batch_id: int) -> None:
        known = batch.where(F.col("factor").isNotNull()).select("code", "day", "factor")
        _write_batch(known.groupBy("code", "day").agg(F.max("factor").alias("factor")), table, batch_id)

    return _each_batch(stream, step, checkpoint)


def factor_table(spark: SparkSession, table: str) -> DataFrame:
    """(code, day, factor): what the first pass found, a later shard's value before an earlier one's."""
    return latest_per_key(spark.read.parquet(table), ["code", "day"], ["batch"], ["factor"])


def restore_shards(stream: DataFrame, table: str, out: str, checkpoint: str) -> StreamingQuery:
    """Second pass: every shard's bars with raw prices, by the factors of all shards in force on each bar's day; a partition of ``out`` a batch.

    Factors are matched as of the bar's day and anchored at the latest of the code, wherever in the shards these came.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        factors = factor_table(batch.sparkSession, table)
        _write_batch(adjust.restore_raw(batch.drop("factor"), factors), out, batch_id)

    return _each_batch(stream, step, checkpoint)


def ingest_in_two_passes(shards: Callable[[], DataFrame], table: str, out: str, checkpoint: str) -> None:
    """Both passes over all shards that are there; ``shards`` opens the stream. A run that was broken off anywhere is made good by another."""
    fold_factors(shards(), table, f"{checkpoint}/factors").awaitTermination()
    restore_shards(shards(), table, out, f"{checkpoint}/bars").awaitTermination()


def _read_as(like: DataFrame, path: str, partition: str) -> DataFrame:
    """The table at ``path``, its partition column of the type that it has in ``like`` (folder names alone tell numbers and text apart wrongly)."""
    spark = like.sparkSession
    fields = [like.schema[partition] if f.name == partition else f for f in spark.read.parquet(path).schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def merge_partitions(incoming: DataFrame, path: str, key: Sequence[str], partition: str, seq: str | None = None) -> None:
    """``incoming`` put into the table at ``path`` by key; only partitions that it touches are read and written.

    ``partition`` is a column that the key decides, such as its month, so that a key never changes partition. Of several incoming rows of a key the
    last by ``seq`` counts (see ``upsert``). The merged partitions are written aside first; then they take the place of the old ones. If that is
    broken off, merging again gives the whole. A table that is not there yet begins with ``incoming``.
    """
    spark = incoming.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    staged = f"{path.rstrip('/')}-merging"
    stored = _read_as(incoming, path, partition) if fs.exists(where) else incoming.drop(*[seq] if seq else []).limit(0)
    # partition names, of which the driver lists all folders anyway; as plain values they prune the table before any file is opened
    touched = [r[0] for r in incoming.select(partition).distinct().collect()]
    old = stored.where(F.col(partition).isin([v for v in touched if v is not None]) | (F.lit(None in touched) & F.col(partition).isNull()))
    merged = upsert(old, incoming, list(key), seq)
    merged.repartition(partition).write.mode("overwrite").partitionBy(partition).parquet(staged)
    write_partitions(_read_as(incoming, staged, partition), path, partition)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)


def merge_stream(stream: DataFrame, align: Callable[[DataFrame], DataFrame], path: str, key: Sequence[str], partition: str, checkpoint: str, seq: str | None = None) -> StreamingQuery:
    """Every micro-batch aligned and merged by key: a row that comes again corrected replaces the first."""
    return _each_batch(stream, lambda batch, _: merge_partitions(align(batch), path, key, partition, seq), checkpoint)
