import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tapeloom.functions import factors
from tapeloom.functions import indicators as ind


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(f"c{k % 3}", dt.date(2024, 1, 1) + dt.timedelta(days=k), 10 + k % 7 * 0.5, 11 + k % 7 * 0.5, 9 + k % 5 * 0.25) for k in range(150)]
    df = spark.createDataFrame(rows, "code string, day date, close double, high double, low double")
    df.createOrReplaceTempView("bars_f")
    factors.register_sql(spark)
    return df


def test_sql_equals_the_frames(spark, bars):
    for name, columns in (("macd", "dif, dea, macd"), ("sar", "sar"), ("kdj", "k, d, j")):
        got = spark.sql(f"SELECT code, day, {columns} FROM factor_values(TABLE(SELECT code, day, close, high, low FROM bars_f) PARTITION BY (code) ORDER BY (day), '{name}')")
        assert sorted(map(str, got.collect())) == sorted(map(str, factors.factor_table(bars, [name]).collect()))
    assert got.schema["k"].dataType.simpleString() == "double" and got.schema["day"].dataType.simpleString() == "date"


def test_parameters_and_user_factors(spark, bars):
    factors.FACTORS.pop("twice", None)
    factors.factor("twice", ["close"], ["twice"], lambda c, times=2: c * times)
    factors.register_sql(spark)
    rows = spark.sql("SELECT code, day, twice FROM factor_values(TABLE(SELECT code, day, close FROM bars_f) PARTITION BY (code) ORDER BY (day), 'twice', 3)")
    assert rows.agg(F.sum("twice")).first()[0] == pytest.approx(3 * bars.agg(F.sum("close")).first()[0])
    ema = spark.sql("SELECT * FROM factor_values(TABLE(SELECT code, day, close FROM bars_f) PARTITION BY (code) ORDER BY (day), 'ema', 5)").where("code = 'c1'").orderBy("day").collect()
    close = [r.close for r in bars.where("code = 'c1'").orderBy("day").collect()]
    assert [r.ema for r in ema] == pytest.approx(list(ind.ema(__import__("numpy").array(close), 5)))
    with pytest.raises(ValueError, match="twice"):
        factors.factor("twice", ["close"], ["twice"], lambda c: c)


@pytest.mark.parametrize("call, say", [("TABLE(SELECT code, day, close FROM bars_f) PARTITION BY (code) ORDER BY (day), 'nope'", "unknown factor 'nope'"),
                                       ("TABLE(SELECT code, day, close FROM bars_f) PARTITION BY (code) ORDER BY (day), 'sar'", "reads high, low"),
                                       ("TABLE(SELECT code, day, close FROM bars_f) PARTITION BY (code) ORDER BY (day), 'ema', 'x'", "constant numbers"), ("1, 'ema'", "is a table")])
def test_mistakes_fail_in_analysis(spark, bars, call, say):
    with pytest.raises(AnalysisException, match=say):
        spark.sql(f"SELECT * FROM factor_values({call})").schema


def test_nulls_and_empty_tables(spark, bars):
    bars.withColumn("close", F.when(F.col("day") < "2024-01-10", None).otherwise(F.col("close"))).createOrReplaceTempView("bars_n")
    rows = spark.sql("SELECT * FROM factor_values(TABLE(SELECT code, day, close FROM bars_n) PARTITION BY (code) ORDER BY (day), 'ema')").collect()
    assert len(rows) == 150 and sum(r.ema is None for r in rows) == 9
    assert spark.sql("SELECT * FROM factor_values(TABLE(SELECT code, day, close FROM bars_n WHERE false) PARTITION BY (code) ORDER BY (day), 'ema')").count() == 0
