"""Queries over bars: scans, windows, kernels and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import indicators as ind
from tapeloom.operators import bars as B
from tapeloom.operators import kernels as K
from tapeloom.operators.calendar import next_trading_day
from tapeloom.plans.base import BY_CODE, lag, over, query, rolled, round_sql, rounded, stages
from tapeloom.sources.testmap import BARS, FACTORS, REPORTS, TICKS, code_of, daily_bars, factors, reports, table, ticks

S = SparkSession


# scans

@query("s1_bars_by_range", f"SELECT * FROM ({BARS}) WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND code IN ('000007', '000042')")
def s1(spark: S, d: str) -> DataFrame:
    return B.bars_in_range(daily_bars(spark, d), "1996-01-01", "1996-12-31", ["000007", "000042"])


@query("s2_daily_snapshot", f"SELECT day AS trade_date, day, code, open, high, low, close, volume, amount FROM ({BARS}) WHERE day = DATE '1997-03-03'")
def s2(spark: S, d: str) -> DataFrame:
    bars = daily_bars(spark, d)
    odd = F.col("code").cast("int") % 2 == 1
    return B.snapshot([bars.where(odd), bars.where(~odd)], "1997-03-03")


@query("s3_snapshots_latest_tick", """SELECT trade_date, code, ts, price, kind FROM (
  SELECT CAST(ts AS DATE) AS trade_date, code, ts, price, kind, row_number() OVER (PARTITION BY CAST(ts AS DATE), code ORDER BY ts DESC) AS n FROM (""" + TICKS + ")) WHERE n = 1")
def s3(spark: S, d: str) -> DataFrame:
    return B.snapshots([ticks(spark, d).select("code", "ts", "price", "kind")], "ts")


@query("s4_session_ticks", f"""SELECT code, ts, price, id FROM ({TICKS}) WHERE kind = 'view' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 13:30:00'
  AND (hour(ts) * 60 + minute(ts) BETWEEN 571 AND 690 OR hour(ts) * 60 + minute(ts) BETWEEN 781 AND 900)""")
def s4(spark: S, d: str) -> DataFrame:
    return B.session_bars(ticks(spark, d).withColumnRenamed("kind", "freq"), "view", "2024-01-05", "2024-01-20 13:30:00").drop("freq")


@query("s5_benchmark", f"SELECT day, close FROM ({BARS}) WHERE code = '000001' AND day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def s5(spark: S, d: str) -> DataFrame:
    return B.bars_in_range(daily_bars(spark, d), "1996-01-01", "1998-12-31", ["000001"]).select("day", "close")


@query("s6_index_day_bars", f"SELECT * FROM ({BARS}) WHERE code = '000003' AND day < DATE '2000-01-01' ORDER BY day DESC LIMIT 60")
def s6(spark: S, d: str) -> DataFrame:
    return B.index_bars(daily_bars(spark, d), "000003", 60, "2000-01-01")


@query("s18_table_browse", f"SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM ({BARS})")
def s18(spark: S, d: str) -> DataFrame:
    return daily_bars(spark, d).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n"))


# windows

@query("w1_last_n_bars", f"""SELECT code, day, close, CAST(-n AS INTEGER) AS idx FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS n FROM ({BARS})
  WHERE day <= DATE '2000-06-30') WHERE n <= 20""")
def w1(spark: S, d: str) -> DataFrame:
    return B.last_bars(daily_bars(spark, d), 20, "2000-06-30").select("code", "day", "close", "idx")


@query("w3_day_over_day", stages(BARS, [{"prev": lag("close")}, {"chg": "round(close / prev - 1, 8)"}], "code, day, chg"))
def w3(spark: S, d: str) -> DataFrame:
    s = ind.Series(daily_bars(spark, d))
    return s.let(chg=F.round(F.col("close") / s.ref("close") - 1, 8)).result("chg")


@query("w5_first_last_anchor", f"""SELECT code, min(day) AS first_day, max(day) AS last_day, arg_min(close, day) AS first_close, arg_max(close, day) AS last_close FROM ({BARS}) GROUP BY code""")
def w5(spark: S, d: str) -> DataFrame:
    return daily_bars(spark, d).groupBy("code").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min_by("close", "day").alias("first_close"),
                                                   F.max_by("close", "day").alias("last_close"))


@query("w6_run_length_segments", stages(BARS, [{"up": "close > open"}, {"changed": f"CASE WHEN row_number() OVER ({BY_CODE}) = 1 OR up <> {lag('up')} THEN 1 ELSE 0 END"},
       {"segment": over("sum(changed)", "ROWS UNBOUNDED PRECEDING")}], "code, CAST(segment AS BIGINT) AS segment, min(day) AS start, count(*) AS n, any_value(up) AS up", "GROUP BY code, segment"))
def w6(spark: S, d: str) -> DataFrame:
    bars = daily_bars(spark, d).withColumn("up", F.col("close") > F.col("open"))
    runs = K.islands(bars, ["code"], ["day"], F.col("up"))
    return runs.groupBy("code", "segment").agg(F.min("day").alias("start"), F.count("*").alias("n"), F.first("up").alias("up"))


MOMENTUM = stages(BARS, [{"prev": lag("close", 20)}, {"mom": "close / prev - 1"},
                         {"n": "count(mom) OVER (PARTITION BY day)", "r": "rank() OVER (PARTITION BY day ORDER BY mom NULLS LAST)", "c": "count(mom) OVER (PARTITION BY day, mom)"}],
                  "code, day, round((r + (c - 1) / 2.0) / n, 6) AS pct", "WHERE mom IS NOT NULL")


@query("w8_rank_percentile", MOMENTUM)
def w8(spark: S, d: str) -> DataFrame:
    s = ind.Series(daily_bars(spark, d))
    df = s.let(mom=F.col("close") / s.ref("close", 20) - 1).df
    return df.withColumn("pct", F.round(K.percent_rank_average(F.col("mom"), ["day"]), 6)).where(F.col("mom").isNotNull()).select("code", "day", "pct")


@query("w9_winsorize", f"""WITH b AS (SELECT code, day, close FROM ({BARS})),
r AS (SELECT *, floor(count(close) OVER (PARTITION BY day) * 0.1) AS k, row_number() OVER (PARTITION BY day ORDER BY close) AS a, row_number() OVER (PARTITION BY day ORDER BY close DESC) AS d FROM b),
c AS (SELECT *, max(CASE WHEN a = k + 1 THEN close END) OVER (PARTITION BY day) AS lo, max(CASE WHEN d = k + 1 THEN close END) OVER (PARTITION BY day) AS hi FROM r)
SELECT code, day, greatest(least(close, hi), lo) AS close FROM c""")
def w9(spark: S, d: str) -> DataFrame:
    bars = daily_bars(spark, d).select("code", "day", "close")
    return K.winsorize(bars, "close", ["day"], 0.1, "w").select("code", "day", F.col("w").alias("close"))


@query("w10_drawdown", stages(BARS, [{"peak": over("max(close)", "ROWS UNBOUNDED PRECEDING")}], "code, round(min(close / peak - 1), 8) AS worst", "GROUP BY code"))
def w10(spark: S, d: str) -> DataFrame:
    s = ind.Series(daily_bars(spark, d))
    return s.let(dd=F.col("close") / s.hhv("close", 0) - 1).df.groupBy("code").agg(F.round(F.min("dd"), 8).alias("worst"))


@query("w14_first_trading_day_of_month", f"SELECT date_trunc('month', day)::DATE AS month, min(day) AS first_day, max(day) AS last_day FROM ({BARS}) GROUP BY 1")
def w14(spark: S, d: str) -> DataFrame:
    days = daily_bars(spark, d).select("day").distinct()
    return days.groupBy(F.trunc("day", "month").alias("month")).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


# joins on time

ASOF = f"""SELECT b.code, b.day, r.value, r.ann_date FROM ({BARS}) b
ASOF LEFT JOIN (SELECT code, ann_date, max(value) AS value FROM ({REPORTS}) GROUP BY 1, 2) r ON b.code = r.code AND b.day {{op}} r.ann_date"""


@query("j1_asof_backward", ASOF.format(op=">="))
def j1(spark: S, d: str) -> DataFrame:
    return K.asof(daily_bars(spark, d).select("code", "day"), reports(spark, d), ["code"], "day", "ann_date", ["value"], matched_time="ann_date")


@query("j2_asof_strict", ASOF.format(op=">"))
def j2(spark: S, d: str) -> DataFrame:
    return K.asof(daily_bars(spark, d).select("code", "day"), reports(spark, d), ["code"], "day", "ann_date", ["value"], allow_exact=False, matched_time="ann_date")


@query("j3_close_at_period_end", f"""SELECT r.id, r.end_date, round(r.shares * b.close, 4) AS circ_mv FROM ({REPORTS}) r
ASOF LEFT JOIN (SELECT code, day, close FROM ({BARS})) b ON r.code = b.code AND r.end_date >= b.day""")
def j3(spark: S, d: str) -> DataFrame:
    got = K.asof(reports(spark, d), daily_bars(spark, d).select("code", "day", "close"), ["code"], "end_date", "day", ["close"])
    return got.select("id", "end_date", F.round(F.col("shares") * F.col("close"), 4).alias("circ_mv"))


@query("j4_next_trading_day", f"""WITH d AS (SELECT DISTINCT day FROM ({BARS})), e AS (SELECT id, ann_date FROM ({REPORTS}))
SELECT e.id, CASE WHEN datediff('day', e.ann_date, d.day) <= 14 THEN d.day END AS effective FROM e ASOF LEFT JOIN d ON e.ann_date < d.day""")
def j4(spark: S, d: str) -> DataFrame:
    return next_trading_day(reports(spark, d).select("id", "ann_date"), daily_bars(spark, d), "ann_date").select("id", "effective")


@query("j6_range_min", f"""SELECT l.code, l.day, min(r.value) AS low, count(r.value) AS n FROM ({BARS}) l
LEFT JOIN ({REPORTS}) r ON l.code = r.code AND r.ann_date BETWEEN l.day - 20 AND l.day GROUP BY 1, 2""")
def j6(spark: S, d: str) -> DataFrame:
    return K.range_agg(daily_bars(spark, d).select("code", "day"), reports(spark, d), ["code"], "day", "ann_date", 20, 0, low=("value", F.min), n=("value", F.count))


@query("j11_join_on_day", f"SELECT b.code, b.day, f.factor FROM ({BARS}) b LEFT JOIN ({FACTORS}) f ON b.code = f.code AND b.day = f.day")
def j11(spark: S, d: str) -> DataFrame:
    return daily_bars(spark, d).select("code", "day").join(factors(spark, d), ["code", "day"], "left")


@query("j19_fallback_routing", f"""WITH a AS (SELECT *, 0 AS source_rank FROM ({BARS}) WHERE CAST(code AS INT) % 3 = 0 AND day < DATE '1996-06-01'),
b AS (SELECT *, 1 AS source_rank FROM ({BARS}) WHERE CAST(code AS INT) % 2 = 0 AND day < DATE '1996-06-01'), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT code, day, close, source_rank FROM u JOIN (SELECT code, min(source_rank) AS m FROM u GROUP BY code) USING (code) WHERE source_rank = m""")
def j19(spark: S, d: str) -> DataFrame:
    bars, k = daily_bars(spark, d).where(F.col("day") < "1996-06-01"), F.col("code").cast("int")
    return B.route_by_source([bars.where(k % 3 == 0), bars.where(k % 2 == 0)]).select("code", "day", "close", "source_rank")


# projections

@query("p9_field_aliases", f"SELECT code, day, amount AS money, close AS price FROM ({BARS})")
def p9(spark: S, d: str) -> DataFrame:
    return B.select_fields(daily_bars(spark, d), ["money", "price"])


@query("p10_adjusted_where_any", f"""WITH f AS (SELECT *, CASE WHEN CAST(code AS INT) % 2 = 0 AND month(day) > 6 THEN close * 0.5 END AS cf FROM ({BARS}))
SELECT code, day, CASE WHEN max(CASE WHEN cf IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY code) = 1 THEN cf ELSE close END AS close FROM f""")
def p10(spark: S, d: str) -> DataFrame:
    front = F.when((F.col("code").cast("int") % 2 == 0) & (F.month("day") > 6), F.col("close") * 0.5)
    return B.with_adjusted_prices(daily_bars(spark, d).withColumn("close_front", front), "front", ["close"]).select("code", "day", "close")


@query("p24_trend_summary", f"SELECT code, day, open, round(amount / volume, 6) AS vwap, volume, amount FROM ({BARS})")
def p24(spark: S, d: str) -> DataFrame:
    return rounded(B.trend_summary(daily_bars(spark, d)), 6, "vwap")


@query("p27_price_count", f"""SELECT code, day, close, strftime(day, '%Y%m%d') AS trade_date FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS n
  FROM ({BARS}) WHERE day BETWEEN DATE '1998-01-01' AND DATE '1999-12-31') WHERE n <= 5""")
def p27(spark: S, d: str) -> DataFrame:
    return B.price(daily_bars(spark, d), start="1998-01-01", end="1999-12-31", count=5).select("code", "day", "close", "trade_date")


# indicators of windows

def _ind(name: str, make, columns: list[str], steps: list[dict[str, str]], digits: int = 4) -> None:
    @query(name, stages(BARS, steps, f"code, day, {round_sql(digits, *columns)}"))
    def run(spark: S, d: str) -> DataFrame:
        return rounded(make(ind.Series(daily_bars(spark, d))).result(*columns), digits, *columns)


I = {"i": f"row_number() OVER ({BY_CODE})"}
TR = [{"lc": lag("close")}, {"tr": "CASE WHEN lc IS NOT NULL THEN greatest(high - low, abs(lc - high), abs(lc - low)) END"}]


def _pos(x: str, guard: str) -> str:
    return f"CASE WHEN {guard} IS NOT NULL THEN greatest(0.0, {x}) END"


def _div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


_ind("t4_ref_diff", lambda s: s.let(ref5=s.ref("close", 5), diff3=s.diff("close", 3)), ["ref5", "diff3"], [{"ref5": lag("close", 5), "diff3": f"close - {lag('close', 3)}"}], 9)
_ind("t3_const_ret", lambda s: s.let(last_close=s.const("close"), ret3=s.ret("close", 3)), ["last_close", "ret3"],
     [{"last_close": over("last_value(close)", "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"),
       "ret3": "nth_value(close, 3) OVER (PARTITION BY code ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"}], 9)
_ind("t5_sum", lambda s: s.let(sum10=s.sum("volume", 10), total=s.sum("volume", 0)), ["sum10", "total"], [{"sum10": rolled("sum", "volume", 10), "total": over("sum(volume)", "ROWS UNBOUNDED PRECEDING")}])
_ind("t6_ma_std", lambda s: s.let(ma20=s.ma("close", 20), std20=s.std("close", 20)), ["ma20", "std20"], [{"ma20": rolled("avg", "close", 20), "std20": rolled("stddev_pop", "close", 20)}])
_ind("t7_hhv_llv", lambda s: s.let(hhv=s.hhv("high", 20), llv=s.llv("low", 20)), ["hhv", "llv"], [{"hhv": rolled("max", "high", 20), "llv": rolled("min", "low", 20)}], 9)
_ind("t8_bars_since_extreme", lambda s: s.let(hb=s.hhvbars("volume", 10).cast("double"), lb=s.llvbars("volume", 10).cast("double")), ["hb", "lb"],
     [I, {"hi": rolled("max", "volume", 10), "lo": rolled("min", "volume", 10), "vs": over("list(volume)", "ROWS BETWEEN 9 PRECEDING AND CURRENT ROW")},
      {"hb": "CASE WHEN hi IS NOT NULL THEN CAST(list_position(list_reverse(vs), hi) - 1 AS DOUBLE) END", "lb": "CASE WHEN lo IS NOT NULL THEN CAST(list_position(list_reverse(vs), lo) - 1 AS DOUBLE) END"}])
_ind("t9_wma", lambda s: s.let(wma=s.wma("close", 5)), ["wma"], [{"wma": "(" + " + ".join(f"{5 - k} * {lag('close', k) if k else 'close'}" for k in range(5)) + ") / 15"}])
_ind("t10_avedev", lambda s: s.let(avedev=s.avedev("close", 10)), ["avedev"],
     [{"m": rolled("avg", "close", 10), "vs": over("list(close)", "ROWS BETWEEN 9 PRECEDING AND CURRENT ROW")}, {"avedev": "CASE WHEN m IS NOT NULL THEN list_avg(list_transform(vs, lambda x: abs(x - m))) END"}])
_REG = "ROWS BETWEEN 9 PRECEDING AND CURRENT ROW"
_ind("t11_slope_forecast", lambda s: s.let(slope=s.slope("close", 10), forcast=s.forcast("close", 10)), ["slope", "forcast"],
     [I, {"sl": over("regr_slope(close, i)", _REG), "ic": over("regr_intercept(close, i)", _REG)}, {"slope": "CASE WHEN i >= 10 THEN sl END", "forcast": "CASE WHEN i >= 10 THEN ic + sl * i END"}], 3)


def _bools(s: ind.Series) -> ind.Series:
    s.let(up=F.col("close") > F.col("open"))
    up = F.col("up")
    return s.let(cnt=s.count(up, 5), evr=s.every(up, 2), exs=s.exist(up, 3), lst=s.last(up, 3, 1), bl=s.barslast(up), blc=s.barslastcount(up), bsn=s.barssincen(up, 5), vw=s.valuewhen(up, "day"))


@query("t13_t19_conditions", stages(BARS, [{**I, "up": "CASE WHEN close > open THEN 1 ELSE 0 END"}, {
    "cnt": "CASE WHEN i >= 5 THEN " + over("sum(up)", "ROWS BETWEEN 4 PRECEDING AND CURRENT ROW") + " END", "s2": over("sum(up)", "ROWS BETWEEN 1 PRECEDING AND CURRENT ROW"),
    "s3": over("sum(up)", "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"), "p3": over("sum(up)", "ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING"),
    "hit": over("max(CASE WHEN up = 1 THEN i END)", "ROWS UNBOUNDED PRECEDING"), "miss": over("max(CASE WHEN up = 0 THEN i END)", "ROWS UNBOUNDED PRECEDING"),
    "f5": over("min(CASE WHEN up = 1 THEN i END)", "ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"), "vw": over("max(CASE WHEN up = 1 THEN day END)", "ROWS UNBOUNDED PRECEDING")}],
    "code, day, CAST(cnt AS BIGINT) AS cnt, i >= 2 AND s2 = 2 AS evr, i >= 3 AND s3 > 0 AS exs, coalesce(i >= 4 AND p3 = 3, false) AS lst, coalesce(i - hit, i) AS bl, i - coalesce(miss, 0) AS blc, "
    "CASE WHEN i >= 5 THEN coalesce(i - f5, 0) ELSE 0 END AS bsn, vw"))
def t13(spark: S, d: str) -> DataFrame:
    return _bools(ind.Series(daily_bars(spark, d))).result("cnt", "evr", "exs", "lst", "bl", "blc", "bsn", "vw")


@query("t18_cross", stages(BARS, [{"a": rolled("avg", "close", 5), "b": rolled("avg", "close", 20)}, {"below": "CASE WHEN a < b THEN 1 ELSE 0 END", "pa": lag("a"), "pb": lag("b")},
       {"p3": over("sum(below)", "ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING")}],
       "code, day, coalesce(NOT (pa > pb) AND a > b, false) AS crossed, coalesce(p3 = 3 AND a > b, false) AS longcross"))
def t18(spark: S, d: str) -> DataFrame:
    s = ind.Series(daily_bars(spark, d))
    s.let(a=s.ma("close", 5), b=s.ma("close", 20))
    return s.let(crossed=s.cross("a", "b"), longcross=s.longcross("a", "b", 3)).result("crossed", "longcross")


_ind("t24_wr", ind.wr, ["wr", "wr1"], [{f"h{n}": rolled("max", "high", n) for n in (10, 6)} | {f"l{n}": rolled("min", "low", n) for n in (10, 6)},
                                       {"wr": _div("h10 - close", "h10 - l10") + " * 100", "wr1": _div("h6 - close", "h6 - l6") + " * 100"}])
_ind("t24_bias", ind.bias, ["bias1", "bias2", "bias3"], [{f"m{n}": rolled("avg", "close", n) for n in (6, 12, 24)}, {f"bias{k}": f"(close - m{n}) / m{n} * 100" for k, n in enumerate((6, 12, 24), 1)}])
_ind("t24_boll", ind.boll, ["boll_mid", "boll_up", "boll_low"], [{"m": rolled("avg", "close", 20), "sd": rolled("stddev_pop", "close", 20)}, {"boll_mid": "m", "boll_up": "m + 2 * sd", "boll_low": "m - 2 * sd"}])
_ind("t24_psy", ind.psy, ["psy", "psyma"], [{**I, "pc": lag("close")}, {"u": "CASE WHEN close > pc THEN 1 ELSE 0 END"},
                                           {"psy": "CASE WHEN i >= 12 THEN " + over("sum(u)", "ROWS BETWEEN 11 PRECEDING AND CURRENT ROW") + " / 12.0 * 100 END"}, {"psyma": rolled("avg", "psy", 6)}])
_ind("t25_cci", ind.cci, ["cci"], [{"tp": "(high + low + close) / 3"}, {"m": rolled("avg", "tp", 14), "vs": over("list(tp)", "ROWS BETWEEN 13 PRECEDING AND CURRENT ROW")},
                                   {"ad": "CASE WHEN m IS NOT NULL THEN list_avg(list_transform(vs, lambda x: abs(x - m))) END"}, {"cci": _div("tp - m", "0.015 * ad")}], 3)
_ind("t26_atr_bbi_taq", lambda s: ind.taq(ind.bbi(ind.atr(s))), ["atr", "bbi", "taq_up", "taq_mid", "taq_down"],
     [*TR, {"atr": rolled("avg", "tr", 20), "h": rolled("max", "high", 20), "l": rolled("min", "low", 20)} | {f"m{n}": rolled("avg", "close", n) for n in (3, 6, 12, 20)},
      {"bbi": "(m3 + m6 + m12 + m20) / 4", "taq_up": "h", "taq_mid": "(h + l) / 2", "taq_down": "l"}], 7)
_ind("t27_dmi", ind.dmi, ["pdi", "mdi", "adx", "adxr"], [*TR, {"hd": f"high - {lag('high')}", "ld": f"{lag('low')} - low"},
     {"dmp": "CASE WHEN hd > 0 AND hd > ld THEN hd ELSE 0.0 END", "dmm": "CASE WHEN ld > 0 AND ld > hd THEN ld ELSE 0.0 END"},
     {"st": rolled("sum", "tr", 14), "sp": rolled("sum", "dmp", 14), "sm": rolled("sum", "dmm", 14)}, {"pdi": _div("sp * 100", "st"), "mdi": _div("sm * 100", "st")},
     {"dx": _div("abs(mdi - pdi)", "pdi + mdi") + " * 100"}, {"adx": rolled("avg", "dx", 6)}, {"adxr": f"(adx + {lag('adx', 6)}) / 2"}], 3)
_ind("t30_vr", ind.vr, ["vr"], [{"lc": lag("close")}, {"u": "CASE WHEN close > lc THEN volume ELSE 0.0 END", "dn": "CASE WHEN close <= lc THEN volume ELSE 0.0 END"},
                               {"vr": _div(rolled("sum", "u", 26), rolled("sum", "dn", 26)) + " * 100"}])
_ind("t30_cr", ind.cr, ["cr"], [{"hlc": "high + low + close"}, {"mid": lag("hlc") + " / 3"}, {"u": _pos("high - mid", "mid"), "dn": _pos("mid - low", "mid")},
                               {"cr": _div(rolled("sum", "u", 20), rolled("sum", "dn", 20)) + " * 100"}], 3)
_ind("t30_emv", ind.emv, ["emv", "maemv"], [{"hl": "high + low", "span": "high - low"}, {"mid": f"100 * (hl - {lag('hl')}) / hl", "vol": "(" + rolled("avg", "volume", 14) + ") / volume", "ms": rolled("avg", "span", 14)},
                                           {"e": _div("mid * vol * span", "ms")}, {"emv": rolled("avg", "e", 14)}, {"maemv": rolled("avg", "emv", 9)}], 3)
_ind("t30_dpo", ind.dpo, ["dpo", "madpo"], [{"m": rolled("avg", "close", 20)}, {"dpo": f"close - {lag('m', 10)}"}, {"madpo": rolled("avg", "dpo", 6)}])
_ind("t30_brar", ind.brar, ["ar", "br"], [{"lc": lag("close"), "ho": "high - open", "ol": "open - low"}, {"u": _pos("high - lc", "lc"), "dn": _pos("lc - low", "lc")},
     {"ar": _div(rolled("sum", "ho", 26), rolled("sum", "ol", 26)) + " * 100", "br": _div(rolled("sum", "u", 26), rolled("sum", "dn", 26)) + " * 100"}], 3)
_ind("t30_dfma", ind.dfma, ["dif", "difma"], [{"dif": f"({rolled('avg', 'close', 10)}) - ({rolled('avg', 'close', 50)})"}, {"difma": rolled("avg", "dif", 10)}])
_ind("t30_mtm", ind.mtm, ["mtm", "mtmma"], [{"mtm": f"close - {lag('close', 12)}"}, {"mtmma": rolled("avg", "mtm", 6)}], 8)
_ind("t30_mass", ind.mass, ["mass", "ma_mass"], [{"span": "high - low"}, {"m1": rolled("avg", "span", 9)}, {"m2": rolled("avg", "m1", 9)}, {"q": _div("m1", "m2")}, {"mass": rolled("sum", "q", 25)}, {"ma_mass": rolled("avg", "mass", 6)}])
_ind("t30_roc", ind.roc, ["roc", "maroc"], [{"roc": f"100 * (close - {lag('close', 12)}) / {lag('close', 12)}"}, {"maroc": rolled("avg", "roc", 6)}])
_ind("t31_obv", ind.obv, ["obv"], [{"lc": lag("close")}, {"v": "CASE WHEN close > lc THEN volume WHEN close < lc THEN -volume ELSE 0.0 END"}, {"obv": over("sum(v)", "ROWS UNBOUNDED PRECEDING") + " / 10000"}])
_ind("t31_mfi", ind.mfi, ["mfi"], [{"tp": "(high + low + close) / 3"}, {"lt": lag("tp")}, {"u": "CASE WHEN tp > lt THEN tp * volume ELSE 0.0 END", "dn": "CASE WHEN tp < lt THEN tp * volume ELSE 0.0 END"},
                                  {"mfi": f"100 - 100 / (1 + {_div(rolled('sum', 'u', 14), rolled('sum', 'dn', 14))})"}])
_ind("t31_asi", ind.asi, ["asi", "asit"], [{"lc": lag("close"), "lo": lag("open"), "ll": lag("low")}, {"a": "abs(high - lc)", "b": "abs(low - lc)", "c": "abs(high - ll)", "dd": "abs(lc - lo)"},
     {"r": "CASE WHEN a > b AND a > c THEN a + b / 2 + dd / 4 WHEN b > c AND b > a THEN b + a / 2 + dd / 4 ELSE c + dd / 4 END"},
     {"si": _div("16 * ((close - lc) + (close - open) / 2 + (lc - lo))", "r") + " * greatest(a, b)"}, {"asi": rolled("sum", "si", 26)}, {"asit": rolled("avg", "asi", 10)}], 5)


# recursive indicators: tested against numpy; here they run over every security

@query("t12_t36_recursive")
def recursive(spark: S, d: str) -> DataFrame:
    hlc = ["close", "high", "low"]
    return ind.recursive(daily_bars(spark, d), [
        ("ema12", ["close"], lambda c: ind.ema(c, 12)), ("sma12", ["close"], lambda c: ind.sma(c, 12)), ("dif,dea,macd", ["close"], ind.macd), ("k,d,j", hlc, ind.kdj),
        ("rsi24", ["close"], ind.rsi), ("rsi6", ["close"], lambda c: ind.rsi(c, 6)), ("trix,trma", ["close"], ind.trix), ("ktn_up,ktn_mid,ktn_low", hlc, ind.keltner),
        ("td1,td2,td3,td4", hlc, ind.channel), ("dsma", ["close"], lambda c: ind.deviation_scaled_mean(c, 20)), ("sar", ["high", "low"], ind.parabolic_sar),
        ("sar0", ["high", "low"], ind.parabolic_sar_from_start), ("top", ["close"], ind.top_range), ("low_range", ["close"], ind.low_range),
        ("sumbars", ["volume"], lambda v: ind.sum_bars(v, 200.0)), ("filtered", ["open", "close"], lambda o, c: ind.suppress(c > o, 3)),
        ("hhv_v", ["close", "volume"], lambda c, v: ind.variable_extreme(c, v))])


@query("t12_ema_closed_form", f"""WITH b AS (SELECT code, day, close, row_number() OVER ({BY_CODE}) AS i FROM ({BARS})), n AS (SELECT code, max(i) AS m FROM b GROUP BY code)
SELECT code, round(sum(close * pow(11.0 / 13.0, m - i) * CASE WHEN i = 1 THEN 1.0 ELSE 2.0 / 13.0 END), 4) AS ema12 FROM b JOIN n USING (code) GROUP BY code""")
def ema_last(spark: S, d: str) -> DataFrame:
    rows = ind.recursive(daily_bars(spark, d), [("ema12", ["close"], lambda c: ind.ema(c, 12))])
    return rows.groupBy("code").agg(F.round(F.max_by("ema12", "day"), 4).alias("ema12"))


@query("k1_top_k_per_day", f"""WITH b AS (SELECT code, day, amount, close, row_number() OVER (PARTITION BY day ORDER BY amount DESC, close, code) AS n FROM ({BARS}))
SELECT code, day, amount, CAST(n AS INTEGER) AS rank FROM b WHERE n <= 5""")
def k1(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("day").orderBy(F.desc("amount"), "close", "code")
    return daily_bars(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("code", "day", "amount", "rank")


@query("k2_top_percent", f"""WITH b AS (SELECT code, day, amount, row_number() OVER (PARTITION BY day ORDER BY amount DESC, code) AS n, count(*) OVER (PARTITION BY day) AS c FROM ({BARS}))
SELECT code, day FROM b WHERE n <= greatest(1, floor(c * 0.1))""")
def k2(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("day")
    ranked = daily_bars(spark, d).withColumn("n", F.row_number().over(w.orderBy(F.desc("amount"), "code"))).withColumn("c", F.count("*").over(w))
    return ranked.where(F.col("n") <= F.greatest(F.lit(1), F.floor(F.col("c") * 0.1))).select("code", "day")


@query("entry_momentum_top5", stages(BARS, [{"ma20": rolled("avg", "close", 20), "prev": lag("close", 20)}, {"mom": "close / prev - 1"},
       {"n": "count(mom) OVER (PARTITION BY day)", "r": "rank() OVER (PARTITION BY day ORDER BY mom NULLS LAST)", "c": "count(mom) OVER (PARTITION BY day, mom)",
        "k": "row_number() OVER (PARTITION BY day ORDER BY mom DESC NULLS LAST, code)"}],
       "code, day, round(close, 4) AS close, round(ma20, 4) AS ma20, round((r + (c - 1) / 2.0) / n, 6) AS pct, CAST(k AS INTEGER) AS rank", "WHERE k <= 5 AND mom IS NOT NULL"))
def momentum_top5(spark: S, d: str) -> DataFrame:
    s = ind.Series(daily_bars(spark, d))
    df = s.let(ma20=s.ma("close", 20), mom=F.col("close") / s.ref("close", 20) - 1).df.where(F.col("mom").isNotNull())
    w = Window.partitionBy("day").orderBy(F.desc("mom"), "code")
    ranked = df.withColumn("pct", K.percent_rank_average(F.col("mom"), ["day"])).withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return ranked.select("code", "day", F.round("close", 4).alias("close"), F.round("ma20", 4).alias("ma20"), F.round("pct", 6).alias("pct"), "rank")


@query("j16_dimension_lookup", f"""SELECT code, day, volume, s_nationkey AS nation, n_name AS name FROM ({BARS}) b LEFT JOIN supplier ON code = lpad(CAST(s_suppkey AS VARCHAR), 6, '0') LEFT JOIN nation ON s_nationkey = n_nationkey""")
def j16(spark: S, d: str) -> DataFrame:
    sectors = table(spark, d, "supplier").select(code_of(F.col("s_suppkey")).alias("code"), F.col("s_nationkey").alias("nation"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    bars = daily_bars(spark, d).select("code", "day", "volume")
    return K.lookup(K.lookup(bars, sectors, ["code"], ["nation"]), names, ["nation"], ["name"])
