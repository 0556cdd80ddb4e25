"""Queries over codes, calendars and validation rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.indicators import Series
from tapeloom.operators import audit as D
from tapeloom.operators import calendar as cal
from tapeloom.operators import securities as sec
from tapeloom.operators import validate as V
from tapeloom.plans.base import query
from tapeloom.sources.testmap import BARS, TRADES, daily_bars, table, trades

S = SparkSession

# customers as securities: codes in the forms that sources send
RAW = """SELECT c_custkey AS id, six, c_name AS name, CASE c_custkey % 5 WHEN 0 THEN six WHEN 1 THEN six || '.SH' WHEN 2 THEN 'sz.' || six WHEN 3 THEN six || '.BJ' ELSE 'x' || six END AS raw,
  round(((c_custkey * 37) % 601 - 300) / 1000.0, 3) AS chg FROM (SELECT *, lpad(CAST((c_custkey * 7919) % 1000000 AS VARCHAR), 6, '0') AS six FROM customer)"""


def raw_codes(spark: S, d: str) -> DataFrame:
    k = F.col("c_custkey")
    six = F.lpad(((k * 7919) % 1000000).cast("string"), 6, "0")
    raw = F.when(k % 5 == 0, six).when(k % 5 == 1, F.concat(six, F.lit(".SH"))).when(k % 5 == 2, F.concat(F.lit("sz."), six)).when(k % 5 == 3, F.concat(six, F.lit(".BJ"))).otherwise(F.concat(F.lit("x"), six))
    return table(spark, d, "customer").select(k.alias("id"), six.alias("six"), F.col("c_name").alias("name"), raw.alias("raw"), F.round(((k * 37) % 601 - 300) / 1000.0, 3).alias("chg"))


def _in(code: str, prefixes) -> str:
    return f"left({code}, {len(prefixes[0])}) IN ({', '.join(repr(p) for p in prefixes)})"


BARE = "split_part(upper(trim(raw)), '.', 1)"
END = "CASE WHEN contains(raw, '.') THEN upper(split_part(raw, '.', 2)) ELSE '' END"


@query("p3_normalize_code", f"""SELECT id, CASE WHEN regexp_full_match(raw, '[0-9]{{6}}') THEN raw END AS identity,
  coalesce(nullif(regexp_extract(raw, '^([0-9]{{6}})\\.(SH|SZ|BJ|SI)$', 1), ''), CASE WHEN regexp_full_match(raw, '[0-9]{{6}}') THEN raw END) AS suffixed,
  coalesce(nullif(regexp_extract(raw, '^(sh|sz|bj)\\.([0-9]{{6}})$', 2), ''), CASE WHEN regexp_full_match(raw, '[0-9]{{6}}') THEN raw END) AS prefixed,
  nullif(regexp_extract(raw, '([0-9]{{6}})', 1), '') AS any_form FROM ({RAW})""")
def p3(spark: S, d: str) -> DataFrame:
    c = F.col("raw")
    return raw_codes(spark, d).select("id", sec.normalize_code(c).alias("identity"), sec.normalize_code(c, "suffix").alias("suffixed"), sec.normalize_code(c, "prefix").alias("prefixed"), sec.normalize_code(c, "any").alias("any_form"))


@query("p4_vendor_code", f"""SELECT id, six || '.' || CASE WHEN left(six, 1) = '6' THEN 'SH' WHEN left(six, 1) IN ('0', '3') THEN 'SZ' ELSE 'BJ' END AS stock,
  six || '.' || CASE WHEN left(six, 1) = '5' THEN 'SH' WHEN left(six, 1) = '1' THEN 'SZ' ELSE 'BJ' END AS fund FROM ({RAW})""")
def p4(spark: S, d: str) -> DataFrame:
    return raw_codes(spark, d).select("id", sec.vendor_code(F.col("six"), "STOCK").alias("stock"), sec.vendor_code(F.col("six"), "ETF").alias("fund"))


KIND = f"""CASE WHEN {_in('b', sec.INDEX)} OR (left(b, 3) = '000' AND e IN ('SH', 'SS', 'XSHG')) THEN 'index' WHEN left(b, 3) = '920' THEN 'bse' WHEN left(b, 3) = '688' THEN 'star_market'
  WHEN {_in('b', sec.CHINEXT)} THEN 'chinext' WHEN {_in('b', sec.CONVERTIBLE_BOND)} THEN 'convertible_bond' WHEN {_in('b', sec.ETF)} THEN 'etf' WHEN {_in('b', sec.MAIN_BOARD)} THEN 'main_board' ELSE 'unknown' END"""
VENUE = """CASE WHEN left(b, 3) = '920' THEN 'BJ' WHEN e IN ('SH', 'SS', 'XSHG') THEN 'SH' WHEN e IN ('SZ', 'XSHE') THEN 'SZ' WHEN e IN ('BJ', 'XBJ', 'XBSE') THEN 'BJ'
  WHEN left(b, 3) IN ('110', '111', '113', '118') THEN 'SH' WHEN left(b, 3) IN ('123', '127', '128') THEN 'SZ' WHEN left(b, 1) IN ('5', '6', '9') THEN 'SH' WHEN left(b, 1) IN ('0', '1', '2', '3') THEN 'SZ' ELSE 'SH' END"""


@query("f2_classify_security", f"SELECT id, {KIND} AS kind FROM (SELECT *, {BARE} AS b, {END} AS e FROM ({RAW}))")
def f2(spark: S, d: str) -> DataFrame:
    return raw_codes(spark, d).select("id", sec.classify_security(F.col("raw")).alias("kind"))


@query("f3_exchange", f"SELECT id, {VENUE} AS venue, b || '.' || {VENUE} AS full_code FROM (SELECT *, {BARE} AS b, {END} AS e FROM ({RAW}))")
def f3(spark: S, d: str) -> DataFrame:
    return raw_codes(spark, d).select("id", sec.exchange(F.col("raw")).alias("venue"), sec.with_suffix(F.col("raw")).alias("full_code"))


LIMIT = "CASE WHEN starts_with(nm, 'ST') OR starts_with(nm, '*ST') THEN 0.05 WHEN left(six, 3) IN ('688', '300', '301') THEN 0.2 WHEN left(six, 3) = '920' THEN 0.3 ELSE 0.1 END"
NAMED = f"SELECT *, CASE WHEN id % 9 = 0 THEN 'ST ' || name WHEN id % 9 = 1 THEN '*st' || name ELSE name END AS nm0, upper(CASE WHEN id % 9 = 0 THEN 'ST ' || name WHEN id % 9 = 1 THEN '*st' || name ELSE name END) AS nm FROM ({RAW})"


@query("f4_f6_price_limits", f"""SELECT id, starts_with(nm, 'ST') OR starts_with(nm, '*ST') AS st, CAST({LIMIT} AS DOUBLE) AS lim, chg >= {LIMIT} - 0.001 AS buy_blocked, chg <= -{LIMIT} + 0.001 AS sell_blocked,
  CASE WHEN chg >= {LIMIT} - 0.002 THEN 1 WHEN chg <= -{LIMIT} + 0.002 THEN -1 ELSE 0 END AS state FROM ({NAMED})""")
def f4(spark: S, d: str) -> DataFrame:
    k, name = F.col("id"), F.col("name")
    named = raw_codes(spark, d).withColumn("nm", F.when(k % 9 == 0, F.concat(F.lit("ST "), name)).when(k % 9 == 1, F.concat(F.lit("*st"), name)).otherwise(name))
    lim = sec.price_limit(F.col("six"), F.col("nm"))
    return named.withColumn("lim", lim).select("id", sec.is_st(F.col("nm")).alias("st"), "lim", sec.limit_blocked(F.lit(1), F.col("chg"), F.col("lim")).alias("buy_blocked"),
                                              sec.limit_blocked(F.lit(-1), F.col("chg"), F.col("lim")).alias("sell_blocked"), sec.limit_state(F.col("chg"), F.col("lim")).alias("state"))


@query("f8_round_to_lot", "SELECT o_orderkey AS id, CAST(greatest(floor(o_totalprice / 100) * 100, 0) AS BIGINT) AS lot FROM orders")
def f8(spark: S, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), sec.round_to_lot(F.col("o_totalprice")).cast("long").alias("lot"))


@query("f9_trading_time", "SELECT event_id AS id, hour(ts) * 60 + minute(ts) BETWEEN 570 AND 690 OR hour(ts) * 60 + minute(ts) BETWEEN 780 AND 900 AS trading FROM events")
def f9(spark: S, d: str) -> DataFrame:
    from tapeloom.operators.bars import in_sessions

    return table(spark, d, "events").select(F.col("event_id").alias("id"), in_sessions(F.col("ts"), ((570, 690), (780, 900))).alias("trading"))


@query("f10_trade_cost", f"""WITH f AS (SELECT side, volume, round_even(price * (1 + CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END * 0.002 / 2), 2) AS fill FROM ({TRADES}))
SELECT side, count(*) AS n, round(sum(greatest(fill * volume * 0.0003, 5.0) + CASE WHEN side = 'sell' THEN fill * volume * 0.001 ELSE 0.0 END + fill * volume * 0.00001), 1) AS fees FROM f GROUP BY side""")
def f10(spark: S, d: str) -> DataFrame:
    return sec.trade_cost(trades(spark, d), slippage=0.002).groupBy("side").agg(F.count("*").alias("n"), F.round(F.sum("fees"), 1).alias("fees"))


@query("f12_frequency_labels", "SELECT event_type, CASE event_type WHEN 'view' THEN '1d' WHEN 'click' THEN '5m' ELSE NULL END AS freq, count(*) AS n FROM events GROUP BY 1, 2")
def f12(spark: S, d: str) -> DataFrame:
    label = F.when(F.col("event_type") == "view", "Daily").when(F.col("event_type") == "click", " 5MIN ").otherwise("weekly")
    return table(spark, d, "events").select("event_type", sec.frequency(label).alias("freq")).groupBy("event_type", "freq").agg(F.count("*").alias("n"))


@query("f13_day_arithmetic", "SELECT event_id AS id, day, day * 86400000 - 28800000 AS start_ms, day * 86400000 - 28800000 + 86399999 AS end_ms FROM (SELECT event_id, CAST(floor((epoch_ms(ts) + 28800000) / 86400000) AS BIGINT) AS day FROM events)")
def f13(spark: S, d: str) -> DataFrame:
    ms = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1000
    ms = F.floor(ms)
    return table(spark, d, "events").select(F.col("event_id").alias("id"), cal.local_day_number(ms).alias("day"), cal.day_start_ms(ms).alias("start_ms"), cal.day_end_ms(ms).alias("end_ms"))


@query("f14_classify_fund", """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'money' WHEN p_partkey % 4 = 1 THEN 'gold' WHEN p_partkey % 4 = 2 AND p_partkey % 8 = 2 THEN 'qdii' ELSE 'equity' END AS kind FROM part""")
def f14(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "货币A").when(k % 4 == 1, "黄金ETF").when((k % 4 == 2) & (k % 8 == 2), "德国ETF").otherwise("ETF")
    got = sec.classify_fund(name, F.lit("股票型"), F.lit(""), F.lit("510300"), ["德国"])
    return table(spark, d, "part").select(k.alias("id"), got["kind"].alias("kind"))


@query("p20_code_contract", f"SELECT regexp_full_match(raw, '[0-9]{{6}}') AS good, count(*) AS n FROM ({RAW}) GROUP BY 1")
def p20(spark: S, d: str) -> DataFrame:
    good, bad = sec.split_by_code_contract(raw_codes(spark, d), "raw")
    return good.agg(F.lit(True).alias("good"), F.count("*").alias("n")).unionByName(bad.agg(F.lit(False).alias("good"), F.count("*").alias("n")))


# calendar

@query("i1_calendar_index", f"""WITH d AS (SELECT DISTINCT day FROM ({BARS})) SELECT day, CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS pos, lag(day) OVER (ORDER BY day) AS previous, lead(day) OVER (ORDER BY day) AS next FROM d""")
def i1(spark: S, d: str) -> DataFrame:
    return cal.indexed(daily_bars(spark, d).select("day").distinct())


@query("i1_offset_days", f"""WITH d AS (SELECT DISTINCT day FROM ({BARS})) SELECT day, lead(day, 5) OVER (ORDER BY day) AS shifted FROM d""")
def i1b(spark: S, d: str) -> DataFrame:
    days = daily_bars(spark, d).select("day").distinct()
    return cal.shift_days(days, days, 5)


@query("i3_trading_days_between", f"""WITH d AS (SELECT day, row_number() OVER (ORDER BY day) AS pos FROM (SELECT DISTINCT day FROM ({BARS}))), b AS (SELECT code, min(day) AS first_day, max(day) AS last_day FROM ({BARS}) GROUP BY code)
SELECT code, first_day, last_day, z.pos - a.pos AS trading_days FROM b JOIN d a ON b.first_day = a.day JOIN d z ON b.last_day = z.day""")
def i3(spark: S, d: str) -> DataFrame:
    bars = daily_bars(spark, d)
    ends = bars.groupBy("code").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return cal.trading_days_between(ends, bars.select("day"), "first_day", "last_day").select("code", "first_day", "last_day", F.col("trading_days").cast("long"))


@query("i5_minute_grid", f"SELECT day, count(*) AS n, min(m) AS first_minute, max(m) AS last_minute FROM (SELECT DISTINCT day FROM ({BARS}) WHERE year(day) = 1996) CROSS JOIN (SELECT unnest(range(570, 691)) AS m UNION ALL SELECT unnest(range(781, 901))) GROUP BY day")
def i5(spark: S, d: str) -> DataFrame:
    days = daily_bars(spark, d).where(F.year("day") == 1996).select("day").distinct()
    return cal.minute_grid(days).groupBy("day").agg(F.count("*").alias("n"), F.min("minute").cast("long").alias("first_minute"), F.max("minute").cast("long").alias("last_minute"))


@query("i6_session_windows", f"""SELECT day, a AS start, CASE WHEN day = DATE '1996-03-04' THEN least(z, 800) ELSE z END AS "end" FROM (SELECT DISTINCT day FROM ({BARS}) WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-03-04')
CROSS JOIN (VALUES (571, 690), (781, 900)) s(a, z) WHERE a <= CASE WHEN day = DATE '1996-03-04' THEN least(z, 800) ELSE z END""")
def i6(spark: S, d: str) -> DataFrame:
    days = daily_bars(spark, d).where(F.col("day") >= "1996-01-01").select("day").distinct()
    return cal.session_windows(days, "1996-03-04", 800)


# validation: bars with faults put in by a rule on the key

DIRTY = f"""SELECT * REPLACE (CASE WHEN k % 11 = 0 THEN low - 1 ELSE high END AS high, CASE WHEN k % 13 = 0 THEN amount * 100 ELSE amount END AS amount, CASE WHEN k % 17 = 0 THEN NULL ELSE volume END AS volume,
  CASE WHEN k % 19 = 0 THEN 'sh' || code ELSE code END AS code), CASE WHEN k % 7 = 0 THEN '7min' WHEN k % 7 = 1 THEN NULL ELSE '5min' END AS freq, (k * 60000)::BIGINT AS time,
  close * 0.9 AS close_front, open * 0.9 AS open_front, high0 * 0.9 AS high_front, CASE WHEN k % 23 = 0 THEN NULL WHEN k % 29 = 0 THEN low * 0.7 ELSE low * 0.9 END AS low_front
FROM (SELECT *, high AS high0, CAST(code AS BIGINT) * 31 + datediff('day', DATE '1995-01-01', day) AS k FROM ({BARS}))"""


def dirty_bars(spark: S, d: str) -> DataFrame:
    k = F.col("k")
    bars = daily_bars(spark, d).withColumn("k", F.col("code").cast("long") * 31 + F.datediff("day", F.lit("1995-01-01").cast("date"))).withColumn("high0", F.col("high"))
    return bars.select("day", "k", "open", "low", "close", F.when(k % 11 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"), F.when(k % 13 == 0, F.col("amount") * 100).otherwise(F.col("amount")).alias("amount"),
                       F.when(k % 17 != 0, F.col("volume")).alias("volume"), F.when(k % 19 == 0, F.concat(F.lit("sh"), "code")).otherwise(F.col("code")).alias("code"),
                       F.when(k % 7 == 0, "7min").when(k % 7 != 1, "5min").alias("freq"), (k * 60000).alias("time"), (F.col("close") * 0.9).alias("close_front"), (F.col("open") * 0.9).alias("open_front"),
                       (F.col("high0") * 0.9).alias("high_front"), F.when(k % 23 == 0, None).when(k % 29 == 0, F.col("low") * 0.7).otherwise(F.col("low") * 0.9).alias("low_front"))


SPEC = V.TableSpec({"code": V.ColumnSpec(required=True), "volume": V.ColumnSpec("number", required=True, ge=0), "close": V.ColumnSpec("number", gt=100), "freq": V.ColumnSpec(enum=("5min", "7min"))},
                   amount_unit="yuan", families=("front",), expected_freq="5min")

CHECKS = {
    "RequiredValueNull": "volume IS NULL", "CodeFormat": "NOT regexp_full_match(code, '[0-9]{6}')", "PositiveNumeric": "close <= 100", "DateValid": "time <= 0",
    "OHLCLogic": "high < greatest(low, open, close) - 1e-9 OR low > least(high, open, close) + 1e-9", "UnitCheck": "NOT (amount / (close * volume) BETWEEN 0.5 AND 2.0)",
    "AdjustmentCompleteness_front": "low_front IS NULL",
    "AdjustmentOHLC_front": "high_front < greatest(low_front, open_front, close_front) - 1e-9 OR low_front > least(high_front, open_front, close_front) + 1e-9",
    "AdjustmentFactorConsistency_front": "greatest(abs(open_front / open / m - 1), abs(high_front / high / m - 1), abs(low_front / low / m - 1), abs(close_front / close / m - 1)) > 0.02",
    "FrequencyMissing": "freq IS NULL", "FrequencyInvalid": "freq = '7min'", "FrequencyGrid": "freq = '5min' AND time % 300000 <> 0", "FrequencyMismatch": "freq <> '5min'"}


@query("v1_v16_rule_counts", f"WITH b AS (SELECT *, (open_front / open + high_front / high + low_front / low + close_front / close) / 4 AS m FROM ({DIRTY})) "
       + " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) AS n FROM b WHERE {cond}{' AND low_front IS NOT NULL' if 'Consist' in name or 'OHLC_' in name else ''} HAVING count(*) > 0" for name, cond in CHECKS.items()))
def v_counts(spark: S, d: str) -> DataFrame:
    df = dirty_bars(spark, d)
    return V.count_rules(df, V.rules_for(df, SPEC))


@query("v_split_accepted", f"WITH b AS (SELECT *, (open_front / open + high_front / high + low_front / low + close_front / close) / 4 AS m FROM ({DIRTY})) SELECT code, count(*) AS n FROM b WHERE NOT ("
       + " OR ".join(f"coalesce({c}, false)" for c in CHECKS.values()) + ") GROUP BY code")
def v_accepted(spark: S, d: str) -> DataFrame:
    df = dirty_bars(spark, d)
    return V.accepted(V.validate(df, V.rules_for(df, SPEC))).groupBy("code").agg(F.count("*").alias("n"))


@query("v18_quarantine")
def v_rejected(spark: S, d: str) -> DataFrame:
    df = dirty_bars(spark, d)
    return V.rejected(V.validate(df, V.rules_for(df, SPEC)), "b1", "daily_bar", "test")


@query("v13_duplicate_key", """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END DESC,
  l_partkey * 1000000 + l_suppkey DESC, l_extendedprice DESC, l_shipdate DESC) AS n FROM lineitem) WHERE n = 1""")
def v13(spark: S, d: str) -> DataFrame:
    seq = F.struct((F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_shipdate").alias("c"))
    rows = table(spark, d, "lineitem").withColumn("seq", seq).withColumn("update_flag", (F.col("l_returnflag") == "R").cast("int"))
    return V.keep_one_per_key(rows, ["l_orderkey", "l_linenumber"], "seq").select("l_orderkey", "l_linenumber", "l_partkey")


@query("v15_announcement_logic", """SELECT count(*) FILTER (ann > DATE '1999-06-01' + 7) AS ahead, count(*) FILTER (ann > DATE '1999-06-01' + 7 OR ann < DATE '1997-01-01') AS rejected FROM (SELECT CAST(o_orderdate AS DATE) AS ann FROM orders)""")
def v15(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("ann_date"), F.lit("1997-01-01").cast("date").alias("end_date"))
    warn, strict = V.announcement_rule(False, "1999-06-01"), V.announcement_rule(True, "1999-06-01")
    return rows.agg(F.count_if(warn.rejects).alias("ahead"), F.count_if(strict.rejects).alias("rejected"))


# rules that clean bars cannot break: columns as text, with faults put in by a rule on the key

TYPED = """SELECT CASE WHEN k % 5 = 0 THEN 'n/a' WHEN k % 5 = 1 THEN 'Infinity' ELSE k::VARCHAR END AS amount, CASE WHEN k % 7 = 0 THEN -1 ELSE k % 90 END AS turnover, CASE WHEN k % 11 = 0 THEN 'X' ELSE 'A' END AS market,
  CASE WHEN k % 13 <> 0 THEN k % 2 = 0 END AS is_st, lpad((k % 1000000)::VARCHAR, 6, '0') AS code, k::DOUBLE AS open, k::DOUBLE + 1 AS high, k::DOUBLE AS low, k::DOUBLE AS close,
  CASE WHEN k % 17 = 0 THEN -1.0 ELSE k * 2.0 END AS low_back, k FROM (SELECT l_orderkey * 8 + l_linenumber AS k FROM lineitem)"""


def typed_rows(spark: S, d: str) -> DataFrame:
    k = F.col("k")
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    return rows.select(
        F.when(k % 5 == 0, "n/a").when(k % 5 == 1, "Infinity").otherwise(k.cast("string")).alias("amount"), F.when(k % 7 == 0, -1).otherwise(k % 90).alias("turnover"), F.when(k % 11 == 0, "X").otherwise("A").alias("market"),
        F.when(k % 13 != 0, k % 2 == 0).alias("is_st"), F.lpad((k % 1000000).cast("string"), 6, "0").alias("code"), k.cast("double").alias("open"), (k + 1.0).alias("high"), k.cast("double").alias("low"), k.cast("double").alias("close"),
        (k * 2.0).alias("open_back"), (k * 2.0 + 2).alias("high_back"), F.when(k % 17 == 0, -1.0).otherwise(k * 2.0).alias("low_back"), (k * 2.0).alias("close_back"))


TYPED_SPEC = V.TableSpec({"amount": V.ColumnSpec("number"), "turnover": V.ColumnSpec("number", ge=0), "market": V.ColumnSpec(enum=("A", "B"))}, families=("back",), time_key=None)


@query("v4_v16_typed_rules", f"""WITH t AS ({TYPED}) SELECT * FROM (SELECT 'TypeCheck' AS rule, count(*) FILTER (amount = 'n/a') AS n FROM t UNION ALL SELECT 'InfCheck', count(*) FILTER (amount = 'Infinity') FROM t
UNION ALL SELECT 'RangeCheck', count(*) FILTER (turnover < 0) FROM t UNION ALL SELECT 'EnumCheck', count(*) FILTER (market = 'X') FROM t UNION ALL SELECT 'IsSTNull', count(*) FILTER (is_st IS NULL) FROM t
UNION ALL SELECT 'AdjustmentPositive_back', count(*) FILTER (low_back <= 0) FROM t UNION ALL SELECT 'AdjustmentFactorConsistency_back', count(*) FILTER (
  greatest(abs(2 / m - 1), abs(low_back / low / m - 1)) > 0.02) FROM (SELECT *, (6 + low_back / low) / 4 AS m FROM t)) WHERE n > 0""")
def v_typed(spark: S, d: str) -> DataFrame:
    df = typed_rows(spark, d)
    return V.count_rules(df, V.rules_for(df, TYPED_SPEC))


def _quarantine(spark: S, d: str) -> DataFrame:
    df = typed_rows(spark, d).withColumn("k", F.col("close").cast("long"))
    bad = V.rejected(V.validate(df, V.rules_for(df, TYPED_SPEC)), "b1", "daily_bar", "test")
    key = F.get_json_object("original_payload", "$.k").cast("long")
    return bad.withColumns({"quarantine_id": key, "ingested_at": F.timestamp_seconds(F.lit(946684800) + key % 10 * 86400)})


_BAD = f"""SELECT k, list_filter(['TypeCheck', 'InfCheck', 'RangeCheck', 'EnumCheck', 'AdjustmentPositive_back', 'AdjustmentFactorConsistency_back', 'IsSTNull'], lambda r: CASE r WHEN 'TypeCheck' THEN amount = 'n/a' WHEN 'InfCheck' THEN amount = 'Infinity'
  WHEN 'RangeCheck' THEN turnover < 0 WHEN 'EnumCheck' THEN market = 'X' WHEN 'AdjustmentPositive_back' THEN low_back <= 0 WHEN 'IsSTNull' THEN is_st IS NULL ELSE greatest(abs(2 / m - 1), abs(low_back / low / m - 1)) > 0.02 END) AS rules
  FROM (SELECT *, (6 + low_back / low) / 4 AS m FROM ({TYPED}))"""


@query("v18_rule_alerts", f"""SELECT 'daily_bar' AS table_name, rule, DATE '2000-01-01' + (k % 10)::INTEGER AS day, count(*) AS n FROM (SELECT k, unnest(rules) AS rule FROM ({_BAD})) GROUP BY 1, 2, 3
HAVING count(*) > 20""")
def v18_alerts(spark: S, d: str) -> DataFrame:
    return V.rule_alerts(_quarantine(spark, d), 20)


@query("v18_lifecycle_stats", f"""WITH b AS (SELECT k FROM ({_BAD}) WHERE len(rules) > 0) SELECT 'daily_bar' AS table_name, CASE WHEN k % 6 = 0 THEN 'replayed' WHEN k % 3 = 0 THEN 'fixed' WHEN k % 10 < 4 THEN 'archived' ELSE 'pending' END AS status, count(*) AS n FROM b GROUP BY ALL""")
def v18_stats(spark: S, d: str) -> DataFrame:
    q = V.quarantine_status(_quarantine(spark, d), "2000-01-31", 26)
    q = V.mark_quarantine(q, q.where("quarantine_id % 3 = 0"), "fixed", "2000-02-01")
    return V.quarantine_stats(V.mark_quarantine(q, q.where("quarantine_id % 6 = 0"), "replayed", "2000-02-02"))


@query("d7_frequency_audit", f"""WITH b AS ({DIRTY}), step AS (SELECT *, CASE freq WHEN '1min' THEN 60000 WHEN '5min' THEN 300000 WHEN '15min' THEN 900000 WHEN '30min' THEN 1800000 WHEN '60min' THEN 3600000 END AS ms FROM b)
SELECT 'FrequencyValue' AS "check", 'minute_bar' AS "table", count(*) FILTER (ms IS NULL) AS count, 'error' AS severity FROM step UNION ALL SELECT 'FrequencyGrid', 'minute_bar', count(*) FILTER (time % ms <> 0), 'error' FROM step""")
def d7(spark: S, d: str) -> DataFrame:
    df = dirty_bars(spark, d)
    return D.count_checks(df, "minute_bar", D.frequency_checks(df))


_SOURCED = "SELECT CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'R' THEN 'first' ELSE 'second' END AS data_source, CASE WHEN l_returnflag = 'A' THEN l_tax END AS np_yoy, CASE WHEN l_returnflag = 'R' THEN l_tax END AS or_yoy FROM lineitem"


def _sourced(spark: S, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(F.when(flag == "R", "first").when(flag != "N", "second").alias("data_source"), F.when(flag == "A", F.col("l_tax")).alias("np_yoy"), F.when(flag == "R", F.col("l_tax")).alias("or_yoy"))


@query("d9_source_audit", f"""SELECT 'SourceTraceability' AS "check", 'fin_indicator' AS "table", count(*) FILTER (data_source IS NULL) AS count, 'error' AS severity FROM ({_SOURCED})
UNION ALL SELECT 'AuthoritySourceViolation', 'fin_indicator', count(*) FILTER (data_source <> 'first'), 'error' FROM ({_SOURCED})""")
def d9(spark: S, d: str) -> DataFrame:
    return D.count_checks(_sourced(spark, d), "fin_indicator", D.source_checks("first", allow_fallback=False))


@query("d10_growth_all_null", f"""SELECT 'GrowthFieldAllNull' AS "check", 'fin_indicator' AS "table", 'np_yoy' AS field, count(*) AS count FROM ({_SOURCED}) WHERE data_source = 'first' HAVING count(*) > 0 AND count(np_yoy) = 0
UNION ALL SELECT 'GrowthFieldAllNull', 'fin_indicator', 'or_yoy', count(*) FROM ({_SOURCED}) WHERE data_source = 'first' HAVING count(*) > 0 AND count(or_yoy) = 0""")
def d10(spark: S, d: str) -> DataFrame:
    return D.all_null_fields(_sourced(spark, d), "fin_indicator", ["np_yoy", "or_yoy"], "first")


@query("f7_limit_up", f"""WITH b AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY day) + 1e-6::DOUBLE AS pc FROM ({BARS})), u AS (SELECT *, round(pc * (1 + CASE WHEN substr(code, 6) IN ('3', '8') THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END) , 2) AS up FROM b WHERE pc IS NOT NULL)
SELECT code, day, round(up, 2) AS limit_up, close >= up - 0.002 * pc AS sealed, close >= up - 0.002 * pc AND high > low AS traded FROM u""")
def f7(spark: S, d: str) -> DataFrame:
    s = Series(daily_bars(spark, d))
    s.let(pc=s.ref("close") + 1e-6)  # no price is then exactly between two cents, which engines round differently
    limit = F.when(F.substring("code", 6, 1).isin("3", "8"), 0.2).otherwise(0.1)
    rows = s.df.where(F.col("pc").isNotNull()).withColumn("limit", limit)
    sealed = sec.sealed_at_limit(F.col("close"), F.col("pc"), F.col("limit"))
    return rows.select("code", "day", sec.limit_up_price(F.col("pc"), F.col("limit")).alias("limit_up"), sealed.alias("sealed"), (sealed & (F.col("high") > F.col("low"))).alias("traded"))
