"""Queries of the remaining operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import indicators as ind
from tapeloom.functions.shared import shared_folder
from tapeloom.operators import adjust as A
from tapeloom.operators import breaks as B
from tapeloom.operators import calendar as cal
from tapeloom.operators import grains as G
from tapeloom.operators import pit as P
from tapeloom.operators import range_tree as R
from tapeloom.plans.base import BY_CODE, query
from tapeloom.sources.layout import write_by_curve
from tapeloom.sources.testmap import BARS, REPORTS, TICKS, TRADES, daily_bars, reports, table, ticks, trades

S = SparkSession


@query("t1_t2_elementwise", f"""SELECT code, day, round(abs(close - open), 8) AS gap, round(ln(close), 8) AS log_close, round(sqrt(close), 8) AS root, round(sin(close / 1000), 8) AS sine, round(pow(close, 0.25), 8) AS power,
  greatest(open, close) AS top, least(open, close) AS bottom, (low < close AND close < open) OR (low > close AND close > open) AS inside, CASE WHEN close > open THEN close ELSE open END AS picked FROM ({BARS})""")
def t1(spark: S, d: str) -> DataFrame:
    c, o = F.col("close"), F.col("open")
    return daily_bars(spark, d).select("code", "day", F.round(F.abs(c - o), 8).alias("gap"), F.round(F.log(c), 8).alias("log_close"), F.round(F.sqrt(c), 8).alias("root"), F.round(F.sin(c / 1000), 8).alias("sine"), F.round(F.pow(c, F.lit(0.25)), 8).alias("power"),
                                       ind.larger("open", "close").alias("top"), ind.smaller("open", "close").alias("bottom"), ind.between("close", "low", "open").alias("inside"), ind.if_(c > o, "close", "open").alias("picked"))


@query("p16_p17_last_day_codes", f"SELECT DISTINCT code FROM ({BARS}) WHERE day = (SELECT max(day) FROM ({BARS}) WHERE day <= DATE '1999-06-30') AND volume > 10 AND regexp_matches(code, '[02468]$')")
def p16(spark: S, d: str) -> DataFrame:
    return P.last_day_codes(daily_bars(spark, d).where(F.col("day") <= "1999-06-30"), F.col("volume") > 10, "[02468]$")


@query("p21_k6_events", "SELECT event_id AS source_key, CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS DATE) END AS effective_date FROM events WHERE event_type = 'click'")
def p21(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.col("event_id").alias("source_key"), F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("date")).alias("effective_date"))
    return P.events_by_type(e, "click").select("source_key", "effective_date")


FRESH = f"SELECT code, day, CASE WHEN year(day) = 1997 THEN close * 0.5 ELSE close * 0.8 END AS close_front FROM ({BARS})"


def _stored(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    bars = daily_bars(spark, d).select("code", "day", *A.PRICES, *[(F.col(p) * 0.8).alias(f"{p}_front") for p in A.PRICES])
    return bars, bars.where(F.year("day") == 1997).withColumns({f"{p}_front": F.col(p) * 0.5 for p in A.PRICES})


@query("q9_write_front", f"SELECT code, day, round(close_front, 8) AS close_front FROM ({FRESH})")
def q9(spark: S, d: str) -> DataFrame:
    return A.write_front(*_stored(spark, d)).select("code", "day", F.round("close_front", 8).alias("close_front"))


@query("q14_post_checks", f"SELECT * FROM (VALUES ('PriceRelation', 0), ('ScaleConsistency', 0), ('ReturnConsistency', 0)) v(\"check\", \"count\") UNION ALL SELECT 'RowConservation', count(*) FROM ({BARS}) WHERE year(day) = 2001")
def q14(spark: S, d: str) -> DataFrame:
    stored, fresh = _stored(spark, d)
    return A.post_checks(stored, A.write_front(stored, fresh).where(F.year("day") != 2001))


@query("q15_grid_coverage", f"""WITH h AS (SELECT DISTINCT code, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS m FROM ({TICKS})), g AS (SELECT *, m BETWEEN 570 AND 690 OR m BETWEEN 781 AND 900 AS ok FROM h)
SELECT code, day, CAST(241 AS BIGINT) AS expected, count(*) FILTER (ok) AS present, 241 - count(*) FILTER (ok) AS missing, count(*) FILTER (NOT ok) AS illegal FROM g GROUP BY 1, 2""")
def q15(spark: S, d: str) -> DataFrame:
    t = ticks(spark, d)
    return A.grid_coverage(t, cal.minute_grid(t.select(F.to_date("ts").alias("day")).distinct()))


@query("q23_only_source", f"SELECT count(*) AS n, count(DISTINCT side) AS sources FROM ({TRADES}) WHERE side = 'sell'")
def q23(spark: S, d: str) -> DataFrame:
    return A.only_source(trades(spark, d), "sell", "side").agg(F.count("*").alias("n"), F.count_distinct("side").alias("sources"))


@query("v14_v17_warnings", f"WITH r AS (SELECT *, (close / lag(close) OVER ({BY_CODE}) - 1) * 100 AS pct FROM ({BARS})) SELECT count(*) FILTER (abs(pct) > 400) AS pct_range, count(*) FILTER (abs(close) > 2000) AS extreme FROM r")
def v14(spark: S, d: str) -> DataFrame:
    s = ind.Series(daily_bars(spark, d))
    s.let(pct=(F.col("close") / s.ref("close") - 1) * 100)
    return s.df.agg(F.count_if(F.abs("pct") > 400).alias("pct_range"), F.count_if(F.abs("close") > 2000).alias("extreme"))


@query("u1_union_with_nulls", f"SELECT code, CAST(ann_date AS DATE) AS day, value, NULL::DOUBLE AS close FROM ({REPORTS}) UNION ALL SELECT code, day, NULL, close FROM ({BARS})")
def u1(spark: S, d: str) -> DataFrame:
    return reports(spark, d).select("code", F.col("ann_date").alias("day"), "value").unionByName(daily_bars(spark, d).select("code", "day", "close"), allowMissingColumns=True)


@query("u2_set_operations", f"""WITH a AS (SELECT DISTINCT code FROM ({BARS}) WHERE year(day) = 1995 AND volume > 45), b AS (SELECT DISTINCT code FROM ({BARS}) WHERE year(day) = 1996 AND volume > 45)
SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS common, (SELECT count(*) FROM (FROM a UNION FROM b)) AS either, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_a""")
def u2(spark: S, d: str) -> DataFrame:
    bars = daily_bars(spark, d).where("volume > 45")
    a, b = (bars.where(F.year("day") == y).select("code").distinct() for y in (1995, 1996))
    common, either, only = a.intersect(b), a.union(b).distinct(), a.exceptAll(b)
    return common.agg(F.count("*").alias("common")).crossJoin(either.agg(F.count("*").alias("either"))).crossJoin(only.agg(F.count("*").alias("only_a")))  # one row each


# groups that are a large part of a whole table

FLAGGED = "SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem"


def _flagged(spark: S, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))


@query("w8_rank_in_grains", f"""SELECT l_returnflag, l_orderkey, l_linenumber, round((rank() OVER (PARTITION BY l_returnflag ORDER BY price) + (count(*) OVER (PARTITION BY l_returnflag, price) - 1) / 2.0)
  / count(*) OVER (PARTITION BY l_returnflag), 9) AS pct FROM ({FLAGGED})""")
def w8_grains(spark: S, d: str) -> DataFrame:
    return G.percent_rank_average(_flagged(spark, d), "price", "pct", ["l_returnflag"], 4_000).select("l_returnflag", "l_orderkey", "l_linenumber", F.round("pct", 9).alias("pct"))


@query("w9_winsorize_in_grains", f"""WITH r AS (SELECT *, floor(count(*) OVER (PARTITION BY l_returnflag) * 0.1) AS k, row_number() OVER (PARTITION BY l_returnflag ORDER BY price) AS a, row_number() OVER (PARTITION BY l_returnflag ORDER BY price DESC) AS d FROM ({FLAGGED})),
c AS (SELECT *, max(CASE WHEN a = k + 1 THEN price END) OVER (PARTITION BY l_returnflag) AS lo, max(CASE WHEN d = k + 1 THEN price END) OVER (PARTITION BY l_returnflag) AS hi FROM r)
SELECT l_returnflag, l_orderkey, l_linenumber, greatest(least(price, hi), lo) AS clipped FROM c""")
def w9_grains(spark: S, d: str) -> DataFrame:
    return G.winsorize(_flagged(spark, d), "price", "clipped", 0.1, ["l_returnflag"], 4_000).select("l_returnflag", "l_orderkey", "l_linenumber", "clipped")


@query("d19_quantiles_in_grains", "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(price, {q}), 6) AS {n}" for n, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))) + f" FROM ({FLAGGED}) GROUP BY 1")
def d19_grains(spark: S, d: str) -> DataFrame:
    got = G.quantiles(_flagged(spark, d), "price", ["l_returnflag"], 4_000, p05=0.05, p50=0.5, p95=0.95)
    return got.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p05", "p50", "p95")])


VALUE = f"SELECT ts, id, 1e6 + sum(CASE WHEN kind = 'purchase' THEN price ELSE -price / 7 END) OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS v FROM ({TICKS})"


@query("w10_m3_long_series", f"""WITH v AS ({VALUE}), p AS (SELECT ts, id, v, v / max(v) OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING) - 1 AS fall, v / lag(v) OVER (ORDER BY ts, id) - 1 AS r FROM v)
SELECT count(*) AS n, round(min(fall), 8) AS worst, round(arg_max(v, (ts, id)), 4) AS final, round(avg(r) * 1e6, 6) AS mean_return, round(stddev_samp(r) * 1e6, 5) AS deviation FROM p""")
def w10_long(spark: S, d: str) -> DataFrame:
    flow = F.when(F.col("kind") == "purchase", F.col("price")).otherwise(-F.col("price") / 7)
    total = G.LongSeries(ticks(spark, d), "ts", ["id"], rows=4_000).running(sums={"v": flow}).let(v=F.lit(1e6) + F.col("v")).result("ts", "id", "v")
    got = G.drawdown(total, "v", "ts", ["id"], rows=4_000)
    return got.select("n", F.round("worst", 8).alias("worst"), F.round("final", 4).alias("final"), F.round(F.col("mean_return") * 1e6, 6).alias("mean_return"), F.round(F.col("deviation") * 1e6, 5).alias("deviation"))


MINUTES = f"SELECT kind AS code, date_trunc('minute', ts) AS minute, max(price) AS ratio FROM ({TICKS}) GROUP BY ALL"


@query("w7_q10_segments_by_breaks", f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY minute) AS i FROM ({MINUTES})),
w AS (SELECT code, i, minute, ratio, ratio AS ref, 1 AS segment FROM p WHERE i = 1
  UNION ALL SELECT p.code, p.i, p.minute, p.ratio, CASE WHEN abs(p.ratio - w.ref) > 0.8 * abs(w.ref) THEN p.ratio ELSE w.ref END, w.segment + CASE WHEN abs(p.ratio - w.ref) > 0.8 * abs(w.ref) THEN 1 ELSE 0 END
  FROM w JOIN p ON p.code = w.code AND p.i = w.i + 1)
SELECT code, segment::BIGINT AS segment, min(minute) AS "start", max(minute) AS "end", count(*) AS n, round(median(ratio), 9) AS ratio, round(max(ratio) / nullif(min(ratio), 0) - 1, 6) AS dispersion FROM w GROUP BY code, segment""")
def w7_breaks(spark: S, d: str) -> DataFrame:
    minutes = ticks(spark, d).groupBy(F.col("kind").alias("code"), F.date_trunc("minute", "ts").alias("minute")).agg(F.max("price").alias("ratio"))
    got = A.segment_summary(B.segments_by_breaks(minutes, tolerance=0.8, order="minute"), time="minute")
    return got.select("code", "segment", "start", "end", "n", F.round("ratio", 9).alias("ratio"), F.round("dispersion", 6).alias("dispersion"))


SIDES = """WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 1013 = 3 THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 997 = 5 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 1499 <> 7
  UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 1511 = 9)"""


@query("j18_range_tree_diff", f"""{SIDES} SELECT o_orderkey, o_custkey, o_totalprice, CAST(sum(s) AS BIGINT) AS surplus FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL HAVING sum(s) <> 0""")
def j18_tree(spark: S, d: str) -> DataFrame:
    key, a = F.col("o_orderkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    b = a.where(key % 1499 != 7).select("o_orderkey", F.when(key % 1013 != 3, F.col("o_custkey")).alias("o_custkey"), F.when(key % 997 == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return R.diff_rows(a, b.unionByName(a.where(key % 1511 == 9)), "o_orderkey", 1_000)


@query("s7_bars_by_curve", BARS)
def s7_curve(spark: S, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    bars = daily_bars(spark, d)
    write_by_curve(bars, path, files=32)
    return spark.read.schema(bars.schema).parquet(path)
