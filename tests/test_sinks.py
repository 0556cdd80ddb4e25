import datetime as dt

import pytest

from pyspark.sql import functions as F

from tapeloom.operators import ingest
from tapeloom.sources import export


def bars(spark):
    return spark.createDataFrame([(c, dt.date(2024, 1, d), float(d)) for c in ("600000", "000001", "300750") for d in range(1, 6)], "code string, day date, close double")


def test_bars_round_trip_by_exchange_and_code(spark, tmp_path):
    path = str(tmp_path / "bars")
    export.write_bars(bars(spark), path)
    back = export.read_bars(spark, path)
    assert sorted(map(tuple, back.select("code", "day", "close").collect())) == sorted(map(tuple, bars(spark).collect()))
    assert {r.exchange for r in back.select("exchange").distinct().collect()} == {"SH", "SZ"}


def test_cross_section_is_the_second_latest_day(spark, tmp_path):
    export.write_cross_section(bars(spark), str(tmp_path / "x"))
    assert {r.day for r in spark.read.parquet(str(tmp_path / "x")).collect()} == {dt.date(2024, 1, 4)}


def test_only_touched_partitions_are_overwritten(spark, tmp_path):
    path, df = str(tmp_path / "p"), bars(spark).withColumn("d", F.date_format("day", "yyyyMMdd"))
    export.write_partitions(df, path, "d")
    export.write_partitions(df.where("d = '20240102'").withColumn("close", F.lit(-1.0)), path, "d")
    got = spark.read.parquet(path)
    assert got.count() == 15 and got.where("close = -1").count() == 3


def test_results_as_text(spark, tmp_path):
    export.write_result(bars(spark), str(tmp_path / "c"))
    export.write_result(bars(spark), str(tmp_path / "j"), "json")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == spark.read.json(str(tmp_path / "j")).count() == 15


def test_a_table_is_replaced_by_what_reads_it(spark, tmp_path):
    path = str(tmp_path / "t")
    export.overwrite_table(bars(spark), path)
    export.overwrite_table(spark.read.parquet(path).select("code", F.lit("new").alias("note")), path)
    got = spark.read.parquet(path)
    assert got.columns == ["code", "note"] and got.count() == 15 and not (tmp_path / "t-staged").exists() and not (tmp_path / "t-old").exists()


def test_chunks_resume_where_a_run_broke_off(spark, tmp_path, monkeypatch):
    path, df, day = str(tmp_path / "t"), bars(spark), F.date_format("day", "yyyyMMdd")
    write, calls = export.write_partitions, []

    def breaks(frame, where, by):
        if len(calls) == 2:
            raise RuntimeError("lost")
        calls.append(by)
        write(frame, where, by)

    monkeypatch.setattr(export, "write_partitions", breaks)
    try:
        export.overwrite_in_chunks(df, path, day)
    except RuntimeError:
        pass
    monkeypatch.setattr(export, "write_partitions", write)
    assert export.overwrite_in_chunks(df, path, day) == {"chunks": 5, "resumed": 2, "rows": 15}
    assert sorted(map(tuple, spark.read.parquet(path).select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    assert export.overwrite_in_chunks(df.limit(3), path, day)["resumed"] == 0


def test_pending_ranges_open_again_only_when_told(spark):
    found = ingest.pending_ranges(bars(spark), "daily")
    resolved = found.withColumn("status", F.lit("resolved"))
    assert ingest.merge_pending(resolved, found).where("status = 'pending'").count() == 0
    assert ingest.merge_pending(resolved, found, reopen=True).where("status = 'pending'").count() == 3 == found.count()


class Lost(Exception):
    pass


@pytest.mark.parametrize("step", range(1, 8))
def test_a_swap_broken_off_anywhere_loses_no_table(spark, tmp_path, monkeypatch, step):
    """The file system fails at its n-th change; what reads the table after ``recover`` sees the old rows or the new."""
    path = str(tmp_path / "t")
    export.overwrite_table(bars(spark), path)
    files, left = export._files, [step]

    class Failing:
        def __init__(self, fs):
            self.fs = fs

        def exists(self, p):
            return self.fs.exists(p)

        def _change(self, f, *a):
            left[0] -= 1
            if left[0] == 0:
                raise Lost
            return f(*a)

        def rename(self, a, b):
            return self._change(self.fs.rename, a, b)

        def delete(self, p, deep):
            return self._change(self.fs.delete, p, deep)

    monkeypatch.setattr(export, "_files", lambda s, p: (Failing(files(s, p)[0]), files(s, p)[1]))
    broken = False
    try:
        export.overwrite_table(bars(spark).limit(4), path)
    except Lost:
        broken = True
    monkeypatch.setattr(export, "_files", files)
    export.recover(spark, path)
    assert spark.read.parquet(path).count() in (4, 15) and (broken or step > 2)
    export.overwrite_table(spark.read.parquet(path).limit(2), path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t-old").exists()


def test_chunks_leave_no_column_and_no_stale_chunk(spark, tmp_path, monkeypatch):
    path, df, day = str(tmp_path / "t"), bars(spark).withColumn("chunk_", F.lit("mine")), F.date_format("day", "yyyy MM/dd")
    swap = export._swap
    monkeypatch.setattr(export, "_swap", lambda *a: (_ for _ in ()).throw(Lost()))
    with pytest.raises(Lost):
        export.overwrite_in_chunks(df, path, day)
    monkeypatch.setattr(export, "_swap", swap)
    kept = df.where("day <> date'2024-01-03'")
    assert export.overwrite_in_chunks(kept, path, day) == {"chunks": 4, "resumed": 4, "rows": 12}
    got = spark.read.parquet(path)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, kept.collect()))
    assert export.overwrite_in_chunks(df.limit(0), path, day) == {"chunks": 0, "resumed": 0, "rows": 0} and spark.read.parquet(path).count() == 0
