"""Queries of ingestion and of the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators import ingest as G
from tapeloom.plans.base import query
from tapeloom.plans.pit_queries import MEMBERS, members
from tapeloom.sources import trade_files
from tapeloom.sources.testmap import BARS, TICKS, code_of, daily_bars, table, ticks
from tapeloom.streaming import pipeline as R

S = SparkSession


@query("p1_map_columns", "SELECT o_orderkey AS id, o_totalprice AS value, o_totalprice AS raw_value FROM orders")
def p1(spark: S, d: str) -> DataFrame:
    return G.map_columns(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), {"raw_value": "o_totalprice"}, {"o_orderkey": "id", "o_totalprice": "value", "gone": "x"})


@query("p5_epoch_ms", """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE epoch_ms(o_orderdate) - 28800000 END AS ms FROM orders""")
def p5(spark: S, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    ms = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), day) * 1000 - 28_800_000
    text = F.when(k % 5 == 0, F.date_format(day, "yyyyMMdd")).when(k % 5 == 1, ms.cast("string")).when(k % 5 == 2, F.date_format(day, "yyyy-MM-dd")).when(k % 5 == 3, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    # ten-digit seconds and thirteen-digit milliseconds are told apart by size, so days before 2001-09-09 are sent as text here
    text = F.when((k % 5 == 1) & (ms <= 1_000_000_000_000), F.date_format(day, "yyyyMMdd")).otherwise(text)
    return table(spark, d, "orders").select(k.alias("id"), G.to_epoch_ms(text).alias("ms"))


@query("p6_p8_units_and_flags", f"SELECT code, day, amount * 1000 AS amount, CASE WHEN v = 0 THEN 1 ELSE 0 END AS suspended FROM (SELECT *, CASE WHEN volume < 3 THEN 0 WHEN volume < 5 THEN NULL ELSE volume END AS v FROM ({BARS}))")
def p6(spark: S, d: str) -> DataFrame:
    v = F.when(F.col("volume") < 3, 0.0).when(F.col("volume") >= 5, F.col("volume"))
    return G.convert_units(daily_bars(spark, d), {"amount": 1000.0}).select("code", "day", "amount", G.suspend_flag(v).alias("suspended"))


@query("p7_round_fields", f"SELECT code, day, round_even(volume, 0) AS volume, round_even(amount / 3, 2) AS amount FROM ({BARS})")
def p7(spark: S, d: str) -> DataFrame:
    return G.round_fields(daily_bars(spark, d).select("code", "day", "volume", (F.col("amount") / 3).alias("amount")))


@query("p25_fold_to_midnight", f"SELECT code, date_trunc('day', ts) AS ts, arg_max(price, ts) AS price, count(*) AS stamps FROM ({TICKS}) GROUP BY code, date_trunc('day', ts)")
def p25(spark: S, d: str) -> DataFrame:
    return G.fold_to_midnight(ticks(spark, d).select("code", "ts", "price")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("s8_second_latest", f"SELECT code, day, close FROM ({BARS}) WHERE day = (SELECT DISTINCT day FROM ({BARS}) ORDER BY day DESC LIMIT 1 OFFSET 1)")
def s8(spark: S, d: str) -> DataFrame:
    return G.second_latest(daily_bars(spark, d)).select("code", "day", "close")


@query("s10_landing_clip", "SELECT o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND o_custkey % 3 <> 0")
def s10(spark: S, d: str) -> DataFrame:
    k = F.col("o_custkey")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("trade_date"), F.concat(code_of(k), F.when(k % 3 == 0, F.lit(".XX")).otherwise(F.lit(".SZ"))).alias("code"))
    return G.clip_landing(rows, "19970101", "19981231", "trade_date").select("id")


@query("s11_s13_clean_trades", "SELECT l_returnflag, CASE l_returnflag WHEN 'R' THEN 'sell' WHEN 'A' THEN 'buy' END AS action, count(*) AS n, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2")
def s11(spark: S, d: str) -> DataFrame:
    f = F.col("l_returnflag")
    rows = table(spark, d, "lineitem").select(f, F.col("l_suppkey").cast("string").alias("code"), F.when(f == "R", " 卖出").when(f == "A", "Buy").otherwise("hold").alias("action"), F.col("l_quantity").cast("string").alias("volume"),
                                             F.lit("1.5").alias("price"), F.col("l_extendedprice").cast("string").alias("amount"))
    return G.positions(G.clean_trades(rows)).groupBy("l_returnflag", "action").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query("s12_research_signals", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 9 IN (6, 7)")
def s12(spark: S, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("00"), (k % 9).cast("string"))).otherwise((k % 9).cast("string")).alias("rating"), F.col("o_custkey").alias("code"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("time"))
    return G.research_signals(rows).select("id", "day")


@query("s14_strategy_events", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders")
def s14(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").cast("string").alias("when"))
    got = G.strategy_events(rows, {"name": "k", "event_date": "when"}, "order", "test")
    return got.agg(F.count("*").alias("n"), F.count_distinct("source_key").alias("keys"), F.min("event_date").alias("first_day"))


@query("s15_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def s15(spark: S, d: str) -> DataFrame:
    o, k = table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey")
    new = o.where(k % 2 == 0).select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(2).alias("seq"))
    new = new.unionByName(new.withColumn("seq", F.lit(1)).withColumn("o_totalprice", F.lit(0.0)))
    return G.upsert(o.where(k % 3 != 0), new, ["o_orderkey"], "seq")


@query("s15_upsert_counts", "SELECT count(*) AS submitted, count(*) FILTER (o_orderkey % 3 = 0) AS new, count(*) FILTER (o_orderkey % 3 <> 0) AS updated FROM orders WHERE o_orderkey % 2 = 0")
def s15b(spark: S, d: str) -> DataFrame:
    o, k = table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey")
    return G.upsert_counts(o.where(k % 3 != 0), o.where(k % 2 == 0), ["o_orderkey"])


@query("q20_clean_intervals", f"SELECT id FROM (SELECT *, CASE WHEN id % 20 = 3 THEN effective_from - 1 ELSE effective_to END AS t FROM ({MEMBERS})) WHERE t IS NULL OR effective_from <= t")
def q20(spark: S, d: str) -> DataFrame:
    rows = members(spark, d).withColumn("effective_to", F.when(F.col("id") % 20 == 3, F.date_sub("effective_from", 1)).otherwise(F.col("effective_to")))
    return G.clean_intervals(rows).select("id")


@query("q21_fund_reference", f"""SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, list_date, last + 1 AS delist_date FROM supplier LEFT JOIN (SELECT code, min(day) AS list_date, max(day) AS last FROM ({BARS}) GROUP BY code) b ON b.code = lpad(CAST(s_suppkey AS VARCHAR), 6, '0') WHERE s_suppkey % 3 = 1""")
def q21(spark: S, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    funds = table(spark, d, "supplier").select(code_of(k).alias("code"), F.when(k % 3 == 0, "ETF联接").when(k % 3 == 1, "Growth etf").otherwise("stock").alias("name"))
    return G.build_fund_reference(funds, daily_bars(spark, d)).select("code", "list_date", "delist_date")


@query("f16_json_payload", "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f16(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k bigint")["k"].alias("k"))


@query("f17_parse_log", "SELECT CAST(ts AS DATE) AS day, 'u' || user_id AS item, count(*) AS n FROM events GROUP BY 1, 2")
def f17(spark: S, d: str) -> DataFrame:
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" picked: ['u"), F.col("user_id").cast("string"), F.lit("', ]"))
    return G.parse_log(table(spark, d, "events").select(line.alias("value"))).groupBy("day", "item").agg(F.count("*").alias("n"))


@query("r2_safe_watermark", f"SELECT kind, CASE WHEN kind = 'view' THEN DATE '2024-01-10' ELSE max(CAST(ts AS DATE)) END AS resume_from FROM ({TICKS}) GROUP BY kind")
def r2(spark: S, d: str) -> DataFrame:
    actual = ticks(spark, d).groupBy("kind").agg(F.max(F.to_date("ts")).alias("actual"))
    stored = actual.select("kind", F.when(F.col("kind") == "view", F.lit("2024-01-10")).when(F.col("kind") == "click", F.lit("2030-01-01")).cast("date").alias("last_date"))
    return G.safe_watermark(stored, actual, ["kind"]).select("kind", "resume_from")


@query("r_tick_bars", f"SELECT code, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, arg_min(price, (ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, id)) AS close, count(*) AS n FROM ({TICKS}) GROUP BY 1, 2")
def r_bars(spark: S, d: str) -> DataFrame:
    return R.bars_from_ticks(ticks(spark, d)).drop("end")


@query("r_sessions", f"""WITH t AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY code ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM ({TICKS})), g AS (SELECT *, sum(c) OVER (PARTITION BY code ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM t)
SELECT code, min(ts) AS start, count(*) AS n, round(sum(price), 4) AS total FROM g GROUP BY code, s""")
def r_sessions(spark: S, d: str) -> DataFrame:
    return R.sessions(ticks(spark, d)).select("code", "start", "n", F.round("total", 4).alias("total"))


@query("r7_completed_bars", f"SELECT code, start FROM (SELECT code, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start FROM ({TICKS}) GROUP BY 1, 2) WHERE start + INTERVAL 1 DAY <= TIMESTAMP '2024-01-20 12:00:00'")
def r7(spark: S, d: str) -> DataFrame:
    bars = R.bars_from_ticks(ticks(spark, d))
    return G.previous_trading_day_filter(bars, F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), "end").select("code", "start")


# late corrections and ranges to fill: bars of codes ending in 3 or 7 are left out on days of the first half of a month

_MISSED = f"SELECT code, day FROM ({BARS}) WHERE substr(code, 6) IN ('3', '7') AND dayofmonth(day) <= 15"


def _missed(spark: S, d: str) -> DataFrame:
    return daily_bars(spark, d).where(F.substring("code", 6, 1).isin("3", "7") & (F.dayofmonth("day") <= 15)).select("code", "day")


@query("r3_apply_corrections", f"""WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 4 = 1 AND o_orderpriority LIKE '1%')
SELECT code, day, CASE WHEN day IN (SELECT day FROM days) THEN volume * 2 ELSE volume END AS volume FROM ({BARS})""")
def r3(spark: S, d: str) -> DataFrame:
    bars = daily_bars(spark, d).select("code", "day", "volume")
    log = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 4 == 1, "daily").otherwise("minute").alias("table_name"), F.col("o_orderdate").cast("date").alias("day"),
                                           F.when(F.col("o_orderpriority").startswith("1"), F.timestamp_seconds(F.lit(200))).otherwise(F.timestamp_seconds(F.lit(100))).alias("changed_at"))
    days = G.repaired_days(log, "1970-01-01 00:02:30", "daily")
    return G.apply_corrections(bars, bars.withColumn("volume", F.col("volume") * 2), days)


_RANGES = f"""SELECT code, min(day) AS range_start, max(day) AS range_end, count(*) AS days FROM (SELECT code, day, day - row_number() OVER (PARTITION BY code ORDER BY day)::INTEGER AS run FROM ({_MISSED})) GROUP BY code, run"""


@query("r5_pending_ranges", f"SELECT 'daily' AS table_name, code, range_start, range_end, days, 'pending' AS status, 'filtered' AS reason FROM ({_RANGES})")
def r5(spark: S, d: str) -> DataFrame:
    return G.pending_ranges(_missed(spark, d), "daily")


def _ledger(spark: S, d: str) -> DataFrame:
    """Ranges of an odd number of days are resolved; finding them again does not open them."""
    found = G.pending_ranges(_missed(spark, d), "daily")
    return G.merge_pending(found.withColumn("status", F.when(F.col("days") % 2 == 1, "resolved").otherwise("pending")), found)


@query("r5_rerun_rows", f"SELECT b.code, b.day, b.volume FROM ({BARS}) b JOIN ({_RANGES}) r ON b.code = r.code AND b.day BETWEEN r.range_start AND r.range_end WHERE r.days % 2 = 0")
def r5b(spark: S, d: str) -> DataFrame:
    return G.rows_to_rerun(daily_bars(spark, d).select("code", "day", "volume"), _ledger(spark, d))


@query("r5_deferred_watermark", f"SELECT 'daily' AS table_name, max(day) AS last_date, least(max(day), (SELECT min(range_start) - 1 FROM ({_RANGES}) WHERE days % 2 = 0)) AS safe_date FROM ({BARS})")
def r5c(spark: S, d: str) -> DataFrame:
    marks = daily_bars(spark, d).agg(F.max("day").alias("last_date")).select(F.lit("daily").alias("table_name"), "last_date")
    return G.deferred_watermark(marks, _ledger(spark, d))


_HEADER, _BUY, _SELL = "证券代码,日期,成交价,数量,买卖\n", "买入", "卖出"


@query("s11_trade_files", f"""SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_returnflag = 'R' THEN '{_SELL}' ELSE '{_BUY}' END AS side,
  l_extendedprice AS price, CAST(l_quantity AS BIGINT) AS volume FROM lineitem""")
def s11_files(spark: S, d: str) -> DataFrame:
    """All trades as files of a security's year, in three encodings by turns, read back as one table."""
    year, by = F.year("l_shipdate"), F.col("l_orderkey") % len(trade_files.ENCODINGS)

    def either(text: str) -> Column:
        """``text`` in the file's encoding; an order mark stands in the header only."""
        plain = ["utf-8", "utf-8", "gbk"]
        return F.element_at(F.array(*[F.lit(text.encode(e)) for e in plain]), (F.col("kind") + 1).cast("int"))

    line = F.concat_ws(",", code_of(F.col("l_suppkey")), F.col("l_shipdate").cast("date").cast("string"), F.col("l_extendedprice").cast("string"), F.col("l_quantity").cast("long").cast("string"), F.lit(""))
    rows = table(spark, d, "lineitem").withColumn("kind", by).select("kind", F.concat_ws("/", "l_suppkey", year, "kind").alias("path"), F.hex(F.concat(
        F.encode(line, "UTF-8"), F.when(F.col("l_returnflag") == "R", either(_SELL)).otherwise(either(_BUY)), F.encode(F.lit("\n"), "UTF-8"))).alias("line"))
    bodies = rows.groupBy("path", "kind").agg(F.unhex(F.array_join(F.collect_list("line"), "")).alias("body"))
    mark = F.when(F.col("kind") == 0, F.lit(b"\xef\xbb\xbf")).otherwise(F.lit(b""))
    files = bodies.select("path", F.concat(mark, either(_HEADER), "body").alias("content"))
    names = dict(zip(_HEADER.strip().split(","), ("code", "day", "price", "volume", "side")))
    return trade_files.parse_files(files, T.StructType.fromDDL("code string, day date, side string, price double, volume long"), names)
