"""Sinks: partitioned bars, cross-sections, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.ingest import second_latest
from tapeloom.operators.kernels import spare
from tapeloom.operators.securities import exchange


def write_bars(bars: DataFrame, path: str, freq: str = "1d", mode: str = "overwrite") -> None:
    """One folder per exchange, code and frequency; a code's rows are gathered first, so each folder gets few files."""
    out = bars.withColumn("exchange", exchange(F.col("code"))).withColumn("freq", F.lit(freq))
    out.repartition("exchange", "code").write.mode(mode).partitionBy("exchange", "code", "freq").parquet(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "false").schema(spark.read.parquet(path).schema).parquet(path).withColumn("code", F.lpad(F.col("code").cast("string"), 6, "0"))


def write_cross_section(df: DataFrame, path: str, day: str = "day") -> None:
    """All fields at the second-latest day."""
    second_latest(df, day).write.mode("overwrite").parquet(path)


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_result(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Results for people: CSV with a header, or JSON lines."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def recover(spark: SparkSession, path: str) -> None:
    """Put the table back that a swap had moved aside when it was broken off; without one, nothing."""
    fs, here = _files(spark, path)
    aside = _files(spark, f"{path.rstrip('/')}-old")[1]
    if fs.exists(aside):
        if not fs.exists(here):
            fs.rename(aside, here)
        else:
            fs.delete(aside, True)


def _swap(spark: SparkSession, staged: str, path: str) -> None:
    """Put a staged folder in the place of ``path``; the old one is moved aside first and goes last."""
    recover(spark, path)
    fs, new = _files(spark, staged)
    old, aside = _files(spark, path)[1], _files(spark, f"{path.rstrip('/')}-old")[1]
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(new, old):
        fs.rename(aside, old)
        raise OSError(f"could not put {staged} in place of {path}")
    fs.delete(aside, True)


def overwrite_table(df: DataFrame, path: str) -> None:
    """Replace a whole table, schema and all, by ``df``, which may read it.

    Until the new table is written whole the old one stands. Then two renames follow, between which a reader may find no table; broken off there,
    ``recover`` or the next overwriting brings the old one back.
    """
    staged = f"{path.rstrip('/')}-staged"
    df.write.mode("overwrite").parquet(staged)
    _swap(df.sparkSession, staged, path)


def _folder(spark: SparkSession, column: str, value: str) -> str:
    """The folder of a partition, as Spark escapes it."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, value)


def overwrite_in_chunks(df: DataFrame, path: str, chunk: Column, resume: bool = True) -> dict[str, int]:
    """``overwrite_table`` chunk by chunk, taken up again where a run broke off.

    ``chunk`` names each row's chunk; there should be few, such as months. A
    chunk is done when its folder and its row in the ledger stand; rows in the
    ledger that differ in number from the staged ones start everything afresh, and
    staged chunks that ``df`` no longer has are dropped. The table has the columns of ``df``.
    Returns how many chunks there are, were done before, and rows.
    """
    recover(df.sparkSession, path)
    spark, staged = df.sparkSession, f"{path.rstrip('/')}-staged"
    ledger, (mark,) = f"{path.rstrip('/')}-ledger", spare(df.columns, "chunk_")
    fs, folder = _files(spark, staged)
    book = _files(spark, ledger)[1]
    named = df.withColumn(mark, F.coalesce(chunk.cast("string"), F.lit("null")))
    done: dict[str, int] = {}
    if resume and fs.exists(folder) and fs.exists(book):
        done = {r["key"]: r["n"] for r in spark.read.parquet(ledger).collect()}
        there = {str(r[mark]): r["count"] for r in spark.read.option("basePath", staged).schema(named.schema).parquet(staged).groupBy(mark).count().collect()}
        if any(there.get(k) != n for k, n in done.items()):
            done = {}
    if not done:
        fs.delete(folder, True)
        fs.delete(book, True)
    keys = sorted(r[mark] for r in named.select(mark).distinct().collect())
    for gone in sorted(set(done) - set(keys)):
        fs.delete(_files(spark, f"{staged}/{_folder(spark, mark, gone)}")[1], True)
        del done[gone]
    before = len(done)
    for key in keys:
        if key not in done:
            write_partitions(named.where(F.col(mark) == key), staged, mark)
            n = spark.read.schema(named.schema).parquet(staged).where(F.col(mark) == key).count()
            spark.createDataFrame([(key, n)], "key string, n long").coalesce(1).write.mode("append").parquet(ledger)
            done[key] = n
    # the table is the chunks without the column that named them
    if fs.exists(folder):
        spark.read.option("basePath", staged).schema(named.schema).parquet(staged).select(*df.columns).write.mode("overwrite").parquet(f"{staged}-whole")
    else:
        df.limit(0).write.mode("overwrite").parquet(f"{staged}-whole")
    _swap(spark, f"{staged}-whole", path)
    fs.delete(folder, True)
    fs.delete(book, True)
    return {"chunks": len(keys), "resumed": before, "rows": sum(done.values())}
