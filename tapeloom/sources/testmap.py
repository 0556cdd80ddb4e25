"""The driver's tables seen as market data.

``daily_bars``: suppliers are securities, shipped lines are trades. ``ticks``:
events are ticks of a security. ``reports``: orders are announced figures.
Each view has its SQL text beside it for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(key: Column) -> Column:
    return F.lpad(key.cast("string"), 6, "0")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, day, open, high, low, close, volume, amount), one row per security and day.

    Trades are aggregated before the shuffle, so a busy code's trades are not one
    task's; only its bars are dealt by code, by the windows over them.
    """
    order = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    trades = (table(spark, sf_dir, "lineitem")
              .select(code_of(F.col("l_suppkey")).alias("code"), F.col("l_shipdate").cast("date").alias("day"),
                      (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity", "l_extendedprice", order.alias("o")))
    return trades.groupBy("code", "day").agg(
        F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "o").alias("close"),
        F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


BARS = """SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS day,
  first(price ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS close,
  sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount
FROM (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem) GROUP BY 1, 2"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, ts, kind, price, id): one row per event."""
    return table(spark, sf_dir, "events").select(code_of(F.col("user_id")).alias("code"), "ts", F.col("event_type").alias("kind"),
                                                F.col("value").alias("price"), F.col("event_id").alias("id"))


TICKS = "SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS code, ts, event_type AS kind, value AS price, event_id AS id FROM events"


def reports(spark: SparkSession, sf_dir: str, codes: int = 100) -> DataFrame:
    """(code, end_date, ann_date, value, shares, id): period figures with the day they became known."""
    ann = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        code_of(F.col("o_custkey") % codes).alias("code"), F.last_day(F.add_months(F.trunc(ann, "quarter"), -1)).alias("end_date"), ann.alias("ann_date"),
        F.col("o_totalprice").alias("value"), (F.col("o_orderkey") % 1000 + 1).cast("double").alias("shares"), F.col("o_orderkey").alias("id"))


REPORTS = """SELECT lpad(CAST(o_custkey % 100 AS VARCHAR), 6, '0') AS code,
  CAST(date_trunc('quarter', CAST(o_orderdate AS DATE)) AS DATE) - 1 AS end_date, CAST(o_orderdate AS DATE) AS ann_date,
  o_totalprice AS value, CAST(o_orderkey % 1000 + 1 AS DOUBLE) AS shares, o_orderkey AS id FROM orders"""


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, day, factor): a cumulative adjustment factor at the first trading day of each quarter."""
    bars = daily_bars(spark, sf_dir)
    first = bars.groupBy("code", F.trunc("day", "quarter").alias("q")).agg(F.min("day").alias("day"))
    step = F.year("q") * 4 + F.quarter("q") - 1995 * 4
    return first.select("code", "day", (1.0 + (step + F.col("code").cast("int") % 7) / F.lit(50.0)).alias("factor"))


FACTORS = f"""SELECT code, day, 1.0::DOUBLE + (year(q) * 4 + quarter(q) - 1995 * 4 + CAST(code AS INTEGER) % 7) / 50.0::DOUBLE AS factor
FROM (SELECT code, date_trunc('quarter', day) AS q, min(day) AS day FROM ({BARS}) GROUP BY 1, 2)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, day, side, price, volume, amount, cost, pnl, id): returned lines are sells."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        code_of(F.col("l_suppkey")).alias("code"), F.col("l_shipdate").cast("date").alias("day"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"), F.col("l_extendedprice").alias("amount"), F.round(F.col("l_extendedprice") * F.col("l_tax"), 2).alias("cost"),
        F.round(F.col("l_extendedprice") * (F.col("l_discount") - 0.05), 2).alias("pnl"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("id"))


TRADES = """SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS day,
  CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_extendedprice / l_quantity AS price, l_quantity AS volume,
  l_extendedprice AS amount, round(l_extendedprice * l_tax, 2) AS cost, round(l_extendedprice * (l_discount - 0.05), 2) AS pnl,
  l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity FROM lineitem"""
