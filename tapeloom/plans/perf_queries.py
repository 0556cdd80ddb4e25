"""Queries over audits and performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import adjust as A
from tapeloom.operators import audit as D
from tapeloom.operators import perf as M
from tapeloom.plans.base import BY_CODE, lag, query, rolled, stages
from tapeloom.plans.pit_queries import ADJUSTED
from tapeloom.sources.testmap import BARS, FACTORS, REPORTS, TICKS, TRADES, daily_bars, factors, reports, table, ticks, trades

S = SparkSession


def _counts(table_name: str, base: str, checks: dict[str, tuple[str, str]]) -> str:
    return f"WITH b AS ({base}) " + " UNION ALL ".join(f"SELECT '{n}' AS \"check\", '{table_name}' AS \"table\", count(*) FILTER ({c}) AS count, '{s}' AS severity FROM b" for n, (c, s) in checks.items())


@query("d2_d8_bar_audit", _counts("daily_bar", BARS, {
    "CodeFormat": ("NOT regexp_full_match(code, '[0-9]{6}')", "error"), "RequiredValueNull": ("code IS NULL OR day IS NULL OR close IS NULL", "error"),
    "RawPriceOHLC": ("high < greatest(open, low, close) - 1e-9 OR low > least(open, high, close) + 1e-9", "error"), "VolumeAmountNegative": ("volume < 0 OR amount < 0", "error"),
    "UnitConsistency": ("NOT (amount / (close * volume) BETWEEN 0.5 AND 2.0)", "warn"), "NotPositive": ("close <= 0", "error"), "FutureTimestamp": ("day > DATE '2001-06-30'", "error")}))
def d2(spark: S, d: str) -> DataFrame:
    return D.count_checks(daily_bars(spark, d), "daily_bar", D.bar_checks("2001-06-30"))


def adjusted(spark: S, d: str) -> DataFrame:
    return A.adjust(daily_bars(spark, d), factors(spark, d))


@query("d1_duplicate_keys", "SELECT count(*) AS keys, coalesce(sum(c - 1), 0)::BIGINT AS surplus FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def d1(spark: S, d: str) -> DataFrame:
    return D.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("d4_adjustment_audit", _counts("daily_bar", f"SELECT *, CAST(code AS INT) + dayofyear(day) AS k FROM ({BARS})", {
    "AdjustmentCompleteness_front": ("k % 31 = 0", "error"), "AdjustmentCoverage_front": ("false", "warn"), "AdjustmentFactorConsistency_front": ("k % 31 <> 0 AND k % 37 = 0", "error")}))
def d4(spark: S, d: str) -> DataFrame:
    from tapeloom.plans.pit_queries import _staged

    return D.count_checks(_staged(spark, d), "daily_bar", D.adjustment_checks("front"))


@query("d5_anchor_check", f"""WITH a AS ({ADJUSTED}) SELECT code, coalesce(abs(arg_max(factor / latest, day) - 1) > 0.02, false) AS front_off, abs(arg_min(factor / earliest, day) - 1) > 0.02 AS back_off FROM a GROUP BY code""")
def d5(spark: S, d: str) -> DataFrame:
    return D.anchor_check(adjusted(spark, d))


@query("d6_return_consistency", stages(ADJUSTED, [{"cf": "close * factor / latest"}, {"g": f"abs((cf / {lag('cf')} - 1) * 100 - (close / {lag('close')} - 1) * 100)"}], "code, count(*) AS n", "WHERE g > 1.0 GROUP BY code"))
def d6(spark: S, d: str) -> DataFrame:
    return D.return_consistency(A.chained_change(adjusted(spark, d).drop("close_front")).join(adjusted(spark, d).select("code", "day", "close_front"), ["code", "day"]), limit=1.0).groupBy("code").agg(F.count("*").alias("n"))


@query("d11_dividend_audit", _counts("dividend", "SELECT o_totalprice AS a, o_totalprice * CASE WHEN o_orderkey % 5 = 0 THEN 1.1 ELSE 0.8 END AS b, o_orderkey % 3 = 0 AS plan FROM orders", {
    "DividendTaxInversion": ("b > a", "error"), "DividendNegative": ("a < 0", "error"), "DividendNonImplemented": ("plan", "info")}))
def d11(spark: S, d: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    rows = table(spark, d, "orders").select(p.alias("cash_before_tax"), (p * F.when(k % 5 == 0, 1.1).otherwise(0.8)).alias("cash_after_tax"), F.when(k % 3 == 0, "预案").otherwise("实施").alias("proc"))
    return D.count_checks(rows, "dividend", D.dividend_checks())


@query("d12_watermark_consistency", f"""WITH a AS (SELECT kind, max(CAST(ts AS DATE)) AS actual FROM ({TICKS}) GROUP BY 1), s AS (SELECT * FROM (VALUES ('view', DATE '2024-01-30'), ('click', DATE '2024-02-05'), ('error', DATE '2024-01-02'), ('gone', DATE '2024-01-01')) t(kind, last_date))
SELECT kind, actual, last_date, CASE WHEN actual IS NULL THEN 'empty' WHEN last_date IS NULL THEN 'missing' WHEN last_date > actual THEN 'ahead' WHEN last_date < actual THEN 'behind' ELSE 'ok' END AS state FROM a FULL JOIN s USING (kind)""")
def d12(spark: S, d: str) -> DataFrame:
    stored = spark.createDataFrame([("view", "2024-01-30"), ("click", "2024-02-05"), ("error", "2024-01-02"), ("gone", "2024-01-01")], "kind string, last_date string").withColumn("last_date", F.to_date("last_date"))
    return D.watermark_consistency(ticks(spark, d), stored, ["kind"], "ts")


@query("s9_d18_watermark_matrix", f"SELECT strftime(day, '%Y-%m') AS month, count(*) AS n, max(day) AS last_day, 'daily_bar' AS \"table\" FROM ({BARS}) GROUP BY 1")
def d18(spark: S, d: str) -> DataFrame:
    return D.watermark_matrix(daily_bars(spark, d), "day", "daily_bar")


@query("d13_minute_against_daily", f"""WITH l AS (SELECT code, CAST(ts AS DATE) AS day, arg_max(price, ts) AS last_price FROM ({TICKS}) GROUP BY 1, 2), dd AS (SELECT code, CAST(ts AS DATE) AS day, max(price) AS close FROM ({TICKS}) GROUP BY 1, 2)
SELECT code, day, last_price, close, CASE WHEN abs(last_price / close - 1) > 0.005 THEN 'error' WHEN abs(last_price / close - 1) > 0.003 THEN 'warn' ELSE 'ok' END AS level FROM l JOIN dd USING (code, day)""")
def d13(spark: S, d: str) -> DataFrame:
    t = ticks(spark, d)
    return D.minute_against_daily(t, t.groupBy("code", F.to_date("ts").alias("day")).agg(F.max("price").alias("close")))


@query("d14_caliber_votes", f"""WITH f AS (SELECT code, day, factor / lag(factor) OVER ({BY_CODE}) AS k FROM ({FACTORS})), m AS (SELECT code, day, close / lag(close) OVER ({BY_CODE}) AS move FROM ({BARS})),
p AS (SELECT abs(ln(move)) AS a, abs(ln(move * k)) AS b, abs(ln(move * k * k)) AS c FROM f JOIN m USING (code, day) WHERE k IS NOT NULL AND abs(k - 1) > 1e-9 AND move > 0),
v AS (SELECT CASE WHEN a <= b AND a <= c THEN 'adjusted' WHEN b <= c THEN 'raw' ELSE 'twice' END AS kind, count(*) AS n FROM p GROUP BY 1) SELECT kind, n, round(n / sum(n) OVER (), 8) AS share, sum(n) OVER () >= 20 AS enough FROM v""")
def d14(spark: S, d: str) -> DataFrame:
    f = factors(spark, d)
    return D.caliber_votes(f.select("code", "day"), f, daily_bars(spark, d)).withColumn("share", F.round("share", 8))


@query("d15_factor_checks", f"SELECT code, count(*) FILTER (s < 1) AS falls, count(*) FILTER (s > 2 OR s < 0.5) AS jumps FROM (SELECT code, factor / lag(factor) OVER ({BY_CODE}) AS s FROM ({FACTORS})) GROUP BY code")
def d15(spark: S, d: str) -> DataFrame:
    return D.factor_checks(factors(spark, d))


@query("d16_invariant", f"SELECT CASE WHEN factor IS NULL THEN 'skipped' WHEN CAST(code AS INT) % 10 = 0 THEN 'broken' ELSE 'ok' END AS state, count(*) AS n FROM ({ADJUSTED}) GROUP BY 1")
def d16(spark: S, d: str) -> DataFrame:
    rows = adjusted(spark, d).withColumn("close_front", F.col("close_front") * F.when(F.col("code").cast("int") % 10 == 0, 1.001).otherwise(1.0))
    return D.invariant(rows.drop("factor", "latest", "earliest"), factors(spark, d), A.anchors(factors(spark, d)))


@query("d17_golden_rows", f"SELECT code, CASE WHEN CAST(code AS INT) % 3 = 0 THEN 'differs' ELSE 'ok' END AS state FROM (SELECT code, max(day) AS day FROM ({BARS}) GROUP BY code)")
def d17(spark: S, d: str) -> DataFrame:
    bars = daily_bars(spark, d)
    pinned = bars.groupBy("code").agg(F.max("day").alias("day"), F.max_by("close", "day").alias("close")).withColumn("close", F.col("close") + F.when(F.col("code").cast("int") % 3 == 0, 1.0).otherwise(0.0))
    return D.golden_rows(bars, pinned, ["code", "day"], "close").select("code", "state")


@query("d19_share_sources", f"""WITH a AS (SELECT code, max(shares) AS x, min(shares) AS y FROM ({REPORTS}) GROUP BY code), g AS (SELECT (x - y) / y * 100 AS g FROM a WHERE y <> 0)
SELECT count(*) AS n, round(avg(g), 4) AS mean, round(quantile_cont(g, 0.5), 4) AS median, round(quantile_cont(abs(g), 0.5), 4) AS median_abs, round(quantile_cont(abs(g), 0.95), 4) AS p95 FROM g""")
def d19(spark: S, d: str) -> DataFrame:
    r = reports(spark, d).groupBy("code")
    got = D.share_sources(r.agg(F.max("shares").alias("shares")), r.agg(F.min("shares").alias("shares")), accuracy=None)  # one row a code
    return got.select("n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "median_abs", "p95")])


@query("d20_queue_health", """SELECT count(*) FILTER (st = 'dead') AS dead, count(*) FILTER (st = 'pending' AND age > 3) AS overdue, count(*) FILTER (st = 'running' AND age > 1) AS stale, count(*) FILTER (k % 10 = 0) AS orphans
FROM (SELECT o_orderkey AS k, datediff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS age, CASE o_orderstatus WHEN 'F' THEN 'dead' WHEN 'O' THEN 'pending' ELSE 'running' END AS st FROM orders)""")
def d20(spark: S, d: str) -> DataFrame:
    st = F.when(F.col("o_orderstatus") == "F", "dead").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("trigger_id"), st.alias("state"), F.col("o_orderdate").cast("date").alias("created"))
    return D.queue_health(q, q.where("trigger_id % 10 <> 0").select("trigger_id"), "2001-12-31")


@query("d21_ex_date_returns", stages(ADJUSTED, [{"cf": "close * factor / latest"}, {"raw_return": f"close / {lag('close')} - 1", "front_return": f"cf / {lag('cf')} - 1"}],
       "code, day, round(raw_return, 7) AS raw_return, round(front_return, 7) AS front_return", f"WHERE (code, day) IN (SELECT code, day FROM ({FACTORS}))"))
def d21(spark: S, d: str) -> DataFrame:
    return D.ex_date_returns(adjusted(spark, d), factors(spark, d)).select("code", "day", F.round("raw_return", 7).alias("raw_return"), F.round("front_return", 7).alias("front_return"))


LEDGER = "SELECT o_custkey AS batch_id, count(*) AS rows_aligned, count(*) FILTER (o_orderstatus = 'F') AS rows_passed, count(*) FILTER (o_orderstatus = 'O') AS rows_rejected, count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 20 <> 0) AS rows_fixed, count(*) FILTER (o_orderstatus = 'F') AS rows_written FROM orders GROUP BY 1"


@query("a15_ledger_conservation", f"SELECT batch_id, rows_aligned <> rows_passed + rows_rejected + rows_fixed AS not_conserved, rows_written > rows_passed AS overwritten, false AS untraced FROM ({LEDGER})")
def a15(spark: S, d: str) -> DataFrame:
    st, o = F.col("o_orderstatus"), table(spark, d, "orders")
    ledger = o.groupBy(F.col("o_custkey").alias("batch_id")).agg(F.count("*").alias("rows_aligned"), F.count_if(st == "F").alias("rows_passed"), F.count_if(st == "O").alias("rows_rejected"),
                                                                F.count_if((st == "P") & (F.col("o_orderkey") % 20 != 0)).alias("rows_fixed"), F.count_if(st == "F").alias("rows_written"))
    return D.ledger_conservation(ledger, o.where(st == "O").groupBy(F.col("o_custkey").alias("batch_id")).agg(F.count("*").alias("quarantined")))


@query("a16_fingerprint")
def a16(spark: S, d: str) -> DataFrame:
    return D.fingerprint(daily_bars(spark, d))


LINES = "SELECT concat_ws(chr(31), l_linenumber::VARCHAR, l_orderkey::VARCHAR, l_partkey::VARCHAR, coalesce(l_returnflag, chr(30)), l_suppkey::VARCHAR) AS line FROM lineitem"


def _lines(spark: S, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("l_returnflag"))


@query("a16_canonical_digest", f"""WITH h AS (SELECT sha256(line) AS h FROM ({LINES.replace("l_returnflag, chr(30)", "nullif(l_returnflag, 'N'), chr(30)")}))
SELECT substr(h, 1, 2) AS shard, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM h GROUP BY 1""")
def a16b(spark: S, d: str) -> DataFrame:
    return D.canonical_digest(_lines(spark, d), 2)


@query("a16_md5_fingerprint", f"""WITH h AS (SELECT ('0x' || substr(md5(line), 1, 15))::BIGINT AS h FROM ({LINES.replace("l_returnflag, chr(30)", "nullif(l_returnflag, 'N'), chr(30)")}))
SELECT count(*) AS n, bit_xor(h) AS xor_hash, sum(h)::VARCHAR AS sum_hash FROM h""")
def a16c(spark: S, d: str) -> DataFrame:
    rows = _lines(spark, d)
    row = F.conv(F.substring(F.md5(D.canonical_line(rows)), 1, 15), 16, 10).cast("long")
    return D.fingerprint(rows, row).withColumn("sum_hash", F.col("sum_hash").cast("string"))


@query("k4_stratified_sample", f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS l, md5(code || '|' || day::VARCHAR || '|7') AS h FROM ({BARS})),
p AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY CASE WHEN l <> 1 THEN 1 ELSE 0 END, h) AS n FROM b)
SELECT code, day, volume FROM (SELECT * FROM p WHERE n <= 20 ORDER BY n, h, code, day LIMIT 5000)""")
def k4(spark: S, d: str) -> DataFrame:
    return D.stratified_sample(daily_bars(spark, d)).select("code", "day", "volume")


@query("k5_golden_days", f"""WITH q AS (SELECT b.code, b.day, f.s FROM ({BARS}) b ASOF JOIN (SELECT code, day, row_number() OVER ({BY_CODE}) AS s FROM ({FACTORS})) f ON b.code = f.code AND b.day >= f.day),
r AS (SELECT *, row_number() OVER (PARTITION BY code, s ORDER BY day) AS n, count(*) OVER (PARTITION BY code, s) AS c FROM q) SELECT code, s AS segment, day FROM r WHERE n = 1 OR n = c OR n = CAST(floor((c - 1) * 0.5 + 0.5) AS INT) + 1""")
def k5(spark: S, d: str) -> DataFrame:
    from pyspark.sql import Window

    seg = factors(spark, d).select("code", F.col("day").alias("start"), F.row_number().over(Window.partitionBy("code").orderBy("day")).cast("long").alias("segment"))
    return D.golden_days(seg, daily_bars(spark, d))


# performance: every security is a portfolio, the mean of all is the benchmark

NAV = f"""SELECT code AS portfolio, day, close / first_value(close) OVER ({BY_CODE}) AS nav, volume AS benchmark FROM ({BARS})"""
RET = f"SELECT *, nav / coalesce(lag(nav) OVER w, 1.0) - 1 AS r, benchmark / coalesce(lag(benchmark) OVER w, first_value(benchmark) OVER w) - 1 AS rb FROM ({NAV}) WINDOW w AS (PARTITION BY portfolio ORDER BY day)"


def returns(spark: S, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("code").orderBy("day")
    nav = daily_bars(spark, d).withColumn("nav", F.col("close") / F.first("close").over(w)).select(F.col("code").alias("portfolio"), "day", "nav", F.col("volume").alias("benchmark"))
    return M.daily_returns(nav)


@query("m1_daily_returns", f"SELECT portfolio, day, round(r, 8) AS r, round(rb, 8) AS rb FROM ({RET})")
def m1(spark: S, d: str) -> DataFrame:
    return returns(spark, d).select("portfolio", "day", F.round("r", 8).alias("r"), F.round("rb", 8).alias("rb"))


@query("m2_m7_metrics", f"""WITH r AS (SELECT *, nav / max(nav) OVER (PARTITION BY portfolio ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS dd, avg(r) OVER (PARTITION BY portfolio) AS m FROM ({RET})),
a AS (SELECT portfolio, count(*) AS n, min(day) AS a, max(day) AS z, arg_max(nav, day) - 1 AS total_return, min(dd) AS max_drawdown, sum((r - m) * (r - m)) AS ss, sum(least(r, 0) * least(r, 0)) AS down, covar_samp(r, rb) AS cov, var_pop(rb) AS vb,
  avg(r - rb) AS ex, stddev_pop(r - rb) AS sdex, avg(CASE WHEN r > rb THEN 1.0 ELSE 0.0 END) AS daily_win_rate, arg_max(benchmark, day) / arg_min(benchmark, day) - 1 AS br FROM r GROUP BY 1),
b AS (SELECT *, pow(1 + total_return, 250.0 / n) - 1 AS annual_return, pow(1 + br, 250.0 / n) - 1 AS ab, (SELECT count(*) FROM range(a, z + INTERVAL 1 DAY, INTERVAL 1 DAY) t(x) WHERE isodow(x) <= 5) AS bd FROM a)
SELECT portfolio, n, round(total_return, 6) AS total_return, round(annual_return, 6) AS annual_return, round(max_drawdown, 6) AS max_drawdown, round(sqrt(250.0 / bd * ss), 4) AS volatility, round((annual_return - 0.03) / sqrt(250.0 / bd * ss), 5) AS sharpe,
  round((annual_return - 0.03) / sqrt(250.0 / n * down), 5) AS sortino, round(cov / vb, 5) AS beta, round(ex / sdex * sqrt(250.0), 5) AS information_ratio, round(daily_win_rate, 6) AS daily_win_rate, round(annual_return - (0.03 + cov / vb * (ab - 0.03)), 5) AS alpha FROM b""")
def m2(spark: S, d: str) -> DataFrame:
    got = M.metrics(returns(spark, d))
    digits = {"total_return": 6, "annual_return": 6, "max_drawdown": 6, "volatility": 4, "daily_win_rate": 6}
    return got.select("portfolio", "n", *[F.round(c, digits.get(c, 5)).alias(c) for c in got.columns if c not in ("portfolio", "n")])


@query("m8_trade_counts", f"""SELECT code, count(*) AS sells, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, round(count(*) FILTER (pnl > 0) / count(*), 6) AS win_rate, round(avg(pnl) FILTER (pnl > 0) / abs(avg(pnl) FILTER (pnl < 0)), 5) AS profit_loss_ratio
FROM ({TRADES}) WHERE side = 'sell' GROUP BY code""")
def m8(spark: S, d: str) -> DataFrame:
    return M.trade_counts(trades(spark, d), ["code"]).withColumn("win_rate", F.round("win_rate", 6)).withColumn("profit_loss_ratio", F.round("profit_loss_ratio", 5))


TRIP = f"SELECT *, row_number() OVER (PARTITION BY code, side ORDER BY day, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS seq FROM ({TRADES})"


@query("m9_round_trips", f"SELECT b.code, b.seq, b.day AS buy_day, s.day AS sell_day, round(s.price / b.price - 1, 8) AS ret FROM ({TRIP}) b JOIN ({TRIP}) s ON b.code = s.code AND b.seq = s.seq AND b.side = 'buy' AND s.side = 'sell'")
def m9(spark: S, d: str) -> DataFrame:
    return M.round_trips(trades(spark, d), ["day", "id"]).select("code", F.col("seq").cast("long").alias("seq"), "buy_day", "sell_day", F.round("ret", 8).alias("ret"))


@query("m10_realised_pnl", f"""WITH RECURSIVE p AS MATERIALIZED (SELECT code, side, price, volume::DOUBLE AS v, row_number() OVER (PARTITION BY code ORDER BY day, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS i FROM ({TRADES})),
r AS (SELECT DISTINCT code, 0::BIGINT AS i, 0e0 AS held, 0e0 AS cost, NULL::DOUBLE AS gain FROM p
UNION ALL SELECT p.code, p.i, CASE WHEN side = 'buy' THEN held + v ELSE held - least(v, held) END,
  CASE WHEN side = 'buy' THEN coalesce((cost * held + price * v) / nullif(held + v, 0), 0e0) ELSE cost END, CASE WHEN side <> 'buy' AND least(v, held) > 0 THEN (price - cost) * least(v, held) END
  FROM r JOIN p ON p.code = r.code AND p.i = r.i + 1)
SELECT code, count(gain) AS sells, count(*) FILTER (gain > 0) AS wins, round(coalesce(sum(gain), 0), 4) AS realised, round(max(gain), 4) AS best, round(min(gain), 4) AS worst FROM r GROUP BY code""")
def m10(spark: S, d: str) -> DataFrame:
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    got = M.realised_pnl(trades(spark, d).select("code", "day", "side", "price", "volume", *[F.col(f"id.{n}").alias(n) for n in names]), ["day", *names])
    return got.withColumns({c: F.round(c, 4) for c in ("realised", "best", "worst")})


@query("a10_vwap", f"SELECT code, day, round(sum(price * volume) / sum(volume), 6) AS vwap FROM ({TRADES}) GROUP BY 1, 2")
def a10(spark: S, d: str) -> DataFrame:
    return M.vwap_per_day(trades(spark, d)).withColumn("vwap", F.round("vwap", 6))


@query("a11_rebuild_nav", f"""WITH f AS (SELECT day, sum(CASE WHEN side = 'buy' THEN amount ELSE -amount END + cost) AS o FROM ({TRADES}) GROUP BY 1), h AS (SELECT day, sum(amount) AS mv FROM ({BARS}) WHERE day < DATE '2000-01-01' GROUP BY 1)
SELECT day, round((1e9 - sum(coalesce(o, 0)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) + coalesce(mv, 0)) / 1e9, 12) AS nav FROM f FULL JOIN h USING (day)""")
def a11(spark: S, d: str) -> DataFrame:
    held = daily_bars(spark, d).where(F.col("day") < "2000-01-01").select("day", F.col("amount").alias("market_value"))
    return M.rebuild_nav(trades(spark, d), held, 1e9).withColumn("nav", F.round("nav", 12))


@query("a12_monthly_returns", "SELECT portfolio, year(day) AS year, " + ", ".join(f"round(product(1 + r) FILTER (month(day) = {m}) - 1, 5) AS \"{m}\"" for m in range(1, 13)) + f" FROM ({RET}) GROUP BY 1, 2")
def a12(spark: S, d: str) -> DataFrame:
    got = M.monthly_returns(returns(spark, d))
    return got.select("portfolio", F.col("year").cast("long").alias("year"), *[F.round(F.col(f"`{m}`"), 5).alias(str(m)) for m in range(1, 13)])


@query("a13_histogram", f"""WITH s AS (SELECT *, min(r) OVER (PARTITION BY portfolio) AS lo, max(r) OVER (PARTITION BY portfolio) AS hi, least(50, count(*) OVER (PARTITION BY portfolio) // 2 + 1) AS b FROM ({RET}))
SELECT portfolio, CAST(least(floor((r - lo) / (hi - lo) * b), b - 1) AS BIGINT) AS bin, count(*) AS n FROM s GROUP BY 1, 2""")
def a13(spark: S, d: str) -> DataFrame:
    return M.histogram(returns(spark, d))


@query("a14_volatility_regime", f"""WITH v AS (SELECT portfolio, CAST(date_trunc('month', day) AS DATE) AS month, stddev_samp(r) * sqrt(252.0) AS vol FROM ({RET}) GROUP BY 1, 2), p AS (SELECT *, list(vol) OVER (PARTITION BY portfolio ORDER BY month ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS past FROM v),
q AS (SELECT *, list_filter(past, lambda x: x IS NOT NULL) AS known FROM p), s AS (SELECT portfolio, month, CASE WHEN len(known) >= 50 THEN len(list_filter(known, lambda x: x <= vol)) / len(known) END AS share FROM q)
SELECT portfolio, month, round(share, 6) AS share, CASE WHEN share > 0.75 THEN 'reversal' WHEN share IS NOT NULL THEN 'momentum' END AS regime FROM s""")
def a14(spark: S, d: str) -> DataFrame:
    return M.volatility_regime(returns(spark, d)).select("portfolio", "month", F.round("share", 6).alias("share"), "regime")


@query("w11_rolling_risk", f"""WITH r AS (SELECT portfolio AS code, day, nav, r FROM ({RET})), v AS (SELECT code, day, {rolled('stddev_samp', 'r', 30)} AS sd, {rolled('avg', 'r', 30)} AS m FROM r) SELECT code AS portfolio, day, round(sd * sqrt(252.0), 4) AS vol, round(m / sd * sqrt(252.0), 5) AS sharpe FROM v""")
def w11(spark: S, d: str) -> DataFrame:
    return M.rolling_risk(returns(spark, d), 30).select("portfolio", "day", F.round("vol", 4).alias("vol"), F.round("sharpe", 5).alias("sharpe"))


@query("w11_rolling_drawdown", f"""WITH v AS (SELECT portfolio, day, CASE WHEN count(r) OVER w = 30 THEN list(nav) OVER w END AS navs FROM ({RET}) WINDOW w AS (PARTITION BY portfolio ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT portfolio, day, CASE WHEN navs IS NOT NULL THEN round(least(0.0, list_min(list_transform(range(1, 31), lambda k: navs[k] / list_max(navs[1:k]) - 1))), 8) END AS drawdown FROM v""")
def w11b(spark: S, d: str) -> DataFrame:
    return M.rolling_risk(returns(spark, d), 30).select("portfolio", "day", F.round("drawdown", 8).alias("drawdown"))


@query("w12_streaks", f"""WITH t AS (SELECT *, sign(pnl) AS s, lag(sign(pnl)) OVER w AS p FROM ({TRADES}) WINDOW w AS (PARTITION BY code ORDER BY day, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> s THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY day, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity ROWS UNBOUNDED PRECEDING) AS run FROM t), r AS (SELECT code, run, any_value(s) AS s, count(*) AS n FROM g GROUP BY 1, 2)
SELECT code, coalesce(max(n) FILTER (s > 0), 0) AS max_wins, coalesce(max(n) FILTER (s < 0), 0) AS max_losses FROM r GROUP BY code""")
def w12(spark: S, d: str) -> DataFrame:
    return M.streaks(trades(spark, d), ["day", "id"])


def _two(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    t = trades(spark, d)
    return t.where(F.col("volume") % 5 != 0), t.where(F.col("volume") % 7 != 0)


TWO = f"WITH t AS ({TRADES}), a AS (SELECT * FROM t WHERE volume % 5 <> 0), b AS (SELECT * FROM t WHERE volume % 7 <> 0)"


@query("m11_signal_agreement", f"""{TWO}, x AS (SELECT DISTINCT day, code, side FROM a), y AS (SELECT DISTINCT day, code, side FROM b), c AS (SELECT (SELECT count(*) FROM x ANTI JOIN y USING (day, code, side)) AS only_a, (SELECT count(*) FROM y ANTI JOIN x USING (day, code, side)) AS only_b, (SELECT count(*) FROM x SEMI JOIN y USING (day, code, side)) AS common)
SELECT *, round(common / (only_a + only_b + common), 8) AS agreement, common / (only_a + only_b + common) >= 0.85 AS ok FROM c""")
def m11(spark: S, d: str) -> DataFrame:
    return M.signal_agreement(*_two(spark, d)).withColumn("agreement", F.round("agreement", 8))


@query("j15_match_rate", f"""{TWO}, x AS (SELECT day, code, side, volume, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT day, code, side, volume, count(*) AS m FROM b GROUP BY ALL)
SELECT sum(least(coalesce(n, 0), coalesce(m, 0)))::BIGINT AS matches, greatest(sum(n), sum(m))::BIGINT AS larger, round(sum(least(coalesce(n, 0), coalesce(m, 0))) / greatest(sum(n), sum(m)), 8) AS rate FROM x FULL JOIN y USING (day, code, side, volume)""")
def j15(spark: S, d: str) -> DataFrame:
    return M.match_rate(*_two(spark, d)).withColumn("rate", F.round("rate", 8))


@query("m12_m15_nav_deviation", f"""WITH x AS (SELECT day, sum(amount) AS x FROM ({BARS}) WHERE code < '000050' GROUP BY 1), y AS (SELECT day, sum(amount) AS y FROM ({BARS}) WHERE code >= '000020' GROUP BY 1),
j AS (SELECT day, x, y, x / lag(x) OVER (ORDER BY day) - 1 AS rx, y / lag(y) OVER (ORDER BY day) - 1 AS ry, x / max(x) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS dx, y / max(y) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS dy FROM x JOIN y USING (day))
SELECT round(arg_max(x, day) / arg_max(y, day) - 1, 6) AS final_gap, round(min(dx) - min(dy), 6) AS drawdown_gap, round((avg(rx) / stddev_samp(rx) - avg(ry) / stddev_samp(ry)) * sqrt(252.0), 5) AS sharpe_gap, round(corr(rx, ry), 6) AS correlation FROM j""")
def m12(spark: S, d: str) -> DataFrame:
    bars = daily_bars(spark, d)
    got = M.nav_deviation(bars.where(F.col("code") < "000050").groupBy("day").agg(F.sum("amount").alias("nav")), bars.where(F.col("code") >= "000020").groupBy("day").agg(F.sum("amount").alias("nav")))
    return got.select(*[F.round(c, 5 if c == "sharpe_gap" else 6).alias(c) for c in got.columns])


@query("m13_daily_overlap", f"{TWO}, x AS (SELECT DISTINCT day, code, 1 AS p FROM a), y AS (SELECT DISTINCT day, code, 1 AS q FROM b) SELECT day, round(count(*) FILTER (p = 1 AND q = 1) / count(*), 8) AS overlap FROM x FULL JOIN y USING (day, code) GROUP BY day")
def m13(spark: S, d: str) -> DataFrame:
    return M.daily_overlap(*_two(spark, d)).withColumn("overlap", F.round("overlap", 8))


@query("m14_cost_gap", f"{TWO}, x AS (SELECT day, code, side, sum(cost) / sum(amount) AS p FROM a GROUP BY ALL), y AS (SELECT day, code, side, sum(cost) / sum(amount) AS q FROM b GROUP BY ALL) SELECT count(*) AS groups, round(avg(abs(p - q)), 8) AS mean_gap FROM x JOIN y USING (day, code, side)")
def m14(spark: S, d: str) -> DataFrame:
    return M.cost_gap(*_two(spark, d)).withColumn("mean_gap", F.round("mean_gap", 8))


@query("m16_reconcile", f"{TWO}, x AS (SELECT day, sum(amount) AS l FROM a GROUP BY 1), y AS (SELECT day, sum(amount) AS r FROM b GROUP BY 1) SELECT day, round(coalesce(l, 0), 2) AS left_amount, round(coalesce(r, 0), 2) AS right_amount, round(coalesce(l, 0) - coalesce(r, 0), 2) AS diff FROM x FULL JOIN y USING (day)")
def m16(spark: S, d: str) -> DataFrame:
    got = M.reconcile(*_two(spark, d))
    return got.select("day", *[F.round(c, 2).alias(c) for c in ("left_amount", "right_amount", "diff")])


@query("f11_dividend_effect", f"""SELECT b.code, b.day, round(volume * value * 0.8, 4) AS net_cash, round(volume * 0.3) AS added FROM ({BARS}) b JOIN (SELECT code, ann_date AS day, max(value) AS value FROM ({REPORTS}) GROUP BY 1, 2) r USING (code, day)""")
def f11(spark: S, d: str) -> DataFrame:
    held = daily_bars(spark, d).select("code", "day", "volume", F.col("close").alias("cost"))
    acts = reports(spark, d).groupBy("code", F.col("ann_date").alias("day")).agg(F.max("value").alias("cash")).withColumn("stock", F.lit(0.3))
    return M.dividend_effect(held, acts).select("code", "day", F.round("net_cash", 4).alias("net_cash"), "added")
