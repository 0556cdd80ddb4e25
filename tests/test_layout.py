"""Files along a space-filling curve."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tapeloom.sources import layout as L


def files_for(path, column, value):
    """Files whose statistics admit ``value``, and all of them."""
    names, hits = glob.glob(f"{path}/*.parquet"), 0
    for name in names:
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            stats = next(s for s in (meta.row_group(g).column(c) for c in range(meta.num_columns)) if s.path_in_schema == column).statistics
            if stats.has_min_max and stats.min <= value <= stats.max:
                hits += 1
                break
    return hits, len(names)


@pytest.fixture(scope="module")
def bars(spark):
    """300 securities on 300 days; one security trades a hundred times a day."""
    df = spark.range(90_000).select(F.lpad((F.col("id") % 300).cast("string"), 6, "0").alias("code"), F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("id") / 300).cast("int")).alias("day"),
                                    F.lit(0).alias("n"), F.lit("x").alias("_at"))
    more = df.where("code = '000007'").select("code", "day", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("n"), "_at")
    return df.unionByName(more)


def test_a_code_and_a_day_read_few_files(spark, bars, tmp_path):
    import datetime

    path = str(tmp_path / "curve")
    L.write_by_curve(bars, path, files=400)
    for column, value in (("code", "000123"), ("day", datetime.date(2020, 5, 5))):
        hit, all_ = files_for(path, column, value)
        assert all_ >= 300 and 0 < hit < all_ / 10
    back = spark.read.parquet(path)
    assert back.columns == bars.columns
    assert back.exceptAll(bars).count() == bars.exceptAll(back).count() == 0
    assert back.where("code = '000123'").count() == 300
    # the busy security's rows are not in one file
    rows = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{path}/*.parquet")]
    assert max(rows) < 6 * sum(rows) / len(rows)


def test_order_of_numbers(spark):
    import datetime

    for kind, values in {"string": ["", "a", "ab", "b", "é", "世"], "date": [datetime.date(1900, 1, 1), datetime.date(1969, 1, 1), datetime.date(2020, 2, 2)], "bigint": [-5, 0, 7], "double": [-1.5, 0.0, 3.25]}.items():
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", L.in_order(F.col("v"), kind).alias("n")).orderBy("i").collect()
        assert [r["n"] for r in rows] == sorted(r["n"] for r in rows) and len({r["n"] for r in rows}) == len(values)


def test_bits_are_interleaved(spark):
    got = spark.range(1).select(L.interleaved([F.lit(0b101), F.lit(0b011)], 3).alias("z")).first()["z"]
    assert got == 0b100111


def test_nulls_empty_tables_and_too_many_columns(spark, bars, tmp_path):
    path = str(tmp_path / "empty")
    L.write_by_curve(bars.limit(0), path)
    assert spark.read.schema(bars.schema).parquet(path).count() == 0
    odd = bars.limit(20).withColumn("day", F.lit(None).cast("date"))
    L.write_by_curve(odd, str(tmp_path / "null"), files=3)
    assert spark.read.parquet(str(tmp_path / "null")).count() == 20
    with pytest.raises(ValueError):
        L.curve(bars, ["code"] * 8, "z")
