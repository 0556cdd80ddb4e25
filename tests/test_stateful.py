import datetime as dt
import os
import time

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from tapeloom.operators import adjust
from tapeloom.sources import export
from tapeloom.streaming import pipeline, shards, stateful

SCHEMA = "code string, day string, factor double, seq long"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def drain(spark, tmp_path, name="run", **options):
    """All rows told so far, after reading what is new."""
    stateful.use_rocksdb(spark)
    stream = pipeline.read_shards(spark, str(tmp_path / "in"), SCHEMA, 1)
    pipeline.drain(stateful.observe_revisions(stream, **options), str(tmp_path / name), str(tmp_path / f"{name}-check"))
    return sorted((r.code, r.day, r.factor, r.revision_no, r.alert, r.expired) for r in spark.read.parquet(str(tmp_path / name)).collect())


def test_a_restart_continues_the_numbers_and_replays_count_once(spark, tmp_path):
    path = str(tmp_path / "in")
    put(spark, path, [("a", "d1", 1.0, 1), ("a", "d1", 2.0, 3), ("a", "d1", 1.0, 2), ("b", "d1", 5.0, 4)])
    first = drain(spark, tmp_path)
    assert first == [("a", "d1", 1.0, 1, False, False), ("a", "d1", 2.0, 2, True, False), ("b", "d1", 5.0, 1, False, False)]
    put(spark, path, [("a", "d1", 1.0, 2), ("a", "d1", 3.0, 9), ("b", "d1", 5.0, 10)])
    assert drain(spark, tmp_path) == sorted([*first, ("a", "d1", 3.0, 3, True, False)])


def test_stream_and_ledger_agree_and_start_from_it(spark, tmp_path):
    ledger = spark.createDataFrame([("a", "d1", 1.0, 1), ("a", "d1", 2.0, 2), ("c", "d1", 4.0, 1)], "code string, day string, factor double, revision_no int")
    new = [("a", "d1", 2.5, 1), ("b", "d1", 5.0, 2), ("c", "d1", 4.0 + 1e-10, 3)]
    put(spark, str(tmp_path / "in"), new)
    batch = adjust.observe(ledger, spark.createDataFrame(new, SCHEMA).drop("seq"), "run").select("code", "day", "factor", "revision_no", "alert").collect()
    assert [r[:5] for r in drain(spark, tmp_path, ledger=ledger)] == sorted(map(tuple, batch)) == [("a", "d1", 2.5, 3, True), ("b", "d1", 5.0, 1, False)]


@pytest.mark.parametrize("told", [True, False])
def test_silent_keys_are_forgotten(spark, tmp_path, told):
    path, kept = str(tmp_path / "in"), {"kept_ms": 1000, "told": told}
    put(spark, path, [("a", "d1", 1.0, 1), ("a", "d1", 2.0, 2)])
    drain(spark, tmp_path, **kept)
    time.sleep(2)
    put(spark, path, [("z", "d1", 1.0, 5)])
    drain(spark, tmp_path, **kept)
    put(spark, path, [("a", "d1", 2.0, 6)])
    rows = drain(spark, tmp_path, **kept)
    assert ("a", "d1", 2.0, 1, False, False) in rows and (("a", "d1", 2.0, 2, False, True) in rows) == told


# two passes

def shard_rows(spark):
    """Bars of three codes with front prices; a factor stands only on the row of the day that it begins."""
    rows = []
    for c in range(3):
        for d in range(24):
            factor = 1.0 + d // 6 * 0.5 + c if d % 6 == 0 else None
            rows.append((f"00000{c}", dt.date(2024, 1, 1) + dt.timedelta(days=d), *[float(10 + d + k) for k in range(4)], factor, d))
    return spark.createDataFrame(rows, "code string, day date, open_front double, high_front double, low_front double, close_front double, factor double, n int")


def write_shards(spark, df, path, parts=4):
    for k in range(parts):  # late days first: a shard's factors may stand in another
        df.where(F.col("n") % parts == parts - 1 - k).drop("n").coalesce(1).write.mode("append").parquet(path)


def shown(df):
    return sorted(map(tuple, df.select("code", "day", F.round("close", 9), "invalid").collect()))


def test_two_passes_equal_the_batch_and_survive_a_break(spark, tmp_path, monkeypatch):
    df = shard_rows(spark)
    write_shards(spark, df, str(tmp_path / "in"))

    def stream():
        return pipeline.read_shards(spark, str(tmp_path / "in"), df.drop("n").schema, 1)

    where = (str(tmp_path / "factors"), str(tmp_path / "out"), str(tmp_path / "check"))
    factors = df.where("factor is not null").select("code", "day", "factor")
    want = shown(adjust.restore_raw(df.drop("n", "factor"), factors))
    restore, done = shards.restore_shards, []
    monkeypatch.setattr(shards, "restore_shards", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        shards.ingest_in_two_passes(stream, *where)
    assert shards.factor_table(spark, where[0]).count() == factors.count() and not os.path.exists(where[1])
    monkeypatch.setattr(shards, "restore_shards", restore)
    for _ in range(2):  # a second run finds nothing to do
        shards.ingest_in_two_passes(stream, *where)
        assert shown(spark.read.parquet(where[1])) == want
    shards.ingest_in_two_passes(stream, *where[:2], str(tmp_path / "afresh"))  # every batch once more
    assert shown(spark.read.parquet(where[1])) == want
    assert not done


# merges by key

def month(df):
    return df.withColumn("month", F.date_format("day", "yyyyMM"))


def test_a_late_correction_replaces_its_row_and_leaves_other_files(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "code string, day date, close double, seq long"
    rows = [(f"c{k % 3}", dt.date(2024, 1 + k % 4, 1 + k), float(k), 1) for k in range(24)]

    def stream():
        return pipeline.read_shards(spark, str(tmp_path / "in"), schema, 1)

    def run():
        shards.merge_stream(stream(), month, path, ["code", "day"], "month", str(tmp_path / "check"), "seq").awaitTermination()

    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert spark.read.parquet(path).count() == 24
    kept = {f: os.stat(f).st_mtime_ns for f in map(str, tmp_path.glob("t/month=20240[134]/*.parquet"))}
    late = [rows[1][:2] + (99.0, 3), rows[1][:2] + (98.0, 2), ("new", dt.date(2024, 2, 28), 7.0, 1)]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = spark.read.parquet(path)
    assert got.count() == 25 and got.where("close = 99").count() == 1 and got.groupBy("code", "day").count().where("count > 1").count() == 0
    rows = sorted(map(tuple, got.collect()))
    assert len(kept) >= 3 and {f: os.stat(f).st_mtime_ns for f in kept} == kept
    shards.merge_partitions(month(spark.createDataFrame(late, schema)), path, ["code", "day"], "month", "seq")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == rows


def test_only_touched_partitions_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    export.write_partitions(month(spark.createDataFrame([("a", dt.date(2024, m, 1), 1.0) for m in range(1, 7)], "code string, day date, close double")), path, "month")
    for f in tmp_path.glob("t/month=20240[1-5]/*.parquet"):
        data = bytearray(f.read_bytes())
        data[4:60] = bytes(56)  # a read of these rows would fail
        f.write_bytes(bytes(data))
        (f.parent / f".{f.name}.crc").unlink()
    with pytest.raises(Py4JJavaError):
        spark.read.parquet(path).collect()
    shards.merge_partitions(month(spark.createDataFrame([("a", dt.date(2024, 6, 1), 2.0)], "code string, day date, close double")), path, ["code", "day"], "month")
    assert [r.close for r in spark.read.parquet(f"{path}/month=202406").collect()] == [2.0]
