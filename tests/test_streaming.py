import datetime as dt

from pyspark.sql import functions as F

from tapeloom.operators import validate
from tapeloom.streaming import pipeline

SCHEMA = "code string, ts timestamp, price double, id long"


def ticks(spark, n=60):
    base = dt.datetime(2024, 1, 1, 9)
    return spark.createDataFrame([(f"00000{k % 3}", base + dt.timedelta(minutes=37 * k), float(k % 11), k) for k in range(n)], SCHEMA)


def shards(spark, tmp_path, df, parts=3):
    path = str(tmp_path / "in")
    for k in range(parts):
        df.where(F.col("id") % parts == k).coalesce(1).write.mode("append").parquet(path)
    return path


def test_tick_bars_stream_equals_batch(spark, tmp_path):
    df = ticks(spark)
    stream = pipeline.read_shards(spark, shards(spark, tmp_path, df), df.schema, 1)
    query = pipeline.bars_from_ticks(stream, "1 hour", "2 days").writeStream.format("memory").queryName("bars").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.table("bars").groupBy("code", "start").agg(F.max_by(F.struct("open", "high", "low", "close", "n"), "n").alias("r")).select("code", "start", "r.*")
    batch = pipeline.bars_from_ticks(df, "1 hour").drop("end")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))


def test_ingest_splits_and_replays_to_the_same(spark, tmp_path):
    df = ticks(spark).withColumn("price", F.when(F.col("id") % 10 != 0, F.col("price")))
    path = shards(spark, tmp_path, df)

    def rules(frame):
        return [validate.Rule("NoPrice", ["price"], F.col("price").isNull())]

    for run in ("c1", "c2"):  # a fresh checkpoint replays every batch
        stream = pipeline.read_shards(spark, path, df.schema, 1)
        pipeline.ingest(stream, rules, lambda f: f, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / run)).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 54
        assert spark.read.parquet(str(tmp_path / "bad")).count() == 6


def test_factor_state_counts_revisions(spark, tmp_path):
    rows = [("a", "d1", 1.0, 1), ("a", "d1", 1.0, 2), ("a", "d1", 2.0, 3), ("b", "d1", 5.0, 4)]
    df = spark.createDataFrame(rows, "code string, day string, factor double, seq long")
    path = str(tmp_path / "f")
    df.coalesce(1).write.parquet(path)
    stream = pipeline.read_shards(spark, path, df.schema)
    q = pipeline.observe_factors(stream).writeStream.format("memory").queryName("factors").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("factors").collect())) == [("a", "d1", 1.0, 1, False), ("a", "d1", 2.0, 2, True), ("b", "d1", 5.0, 1, False)]


def test_sessions(spark):
    got = pipeline.sessions(ticks(spark, 30), "3 hours")
    assert got.agg(F.sum("n")).first()[0] == 30
