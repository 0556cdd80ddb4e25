"""Queries over point-in-time lookups, memberships and price adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.operators import adjust as A
from tapeloom.operators import pit as P
from tapeloom.plans.base import BY_CODE, ORACLE, lag, query, stages
from tapeloom.sources.testmap import BARS, FACTORS, REPORTS, code_of, daily_bars, factors, reports, table

S = SparkSession
DAY = "1999-06-30"


@query("a1_latest_report", f"""SELECT code, end_date, ann_date, value, id FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ann_date DESC, end_date DESC, id DESC) AS n FROM ({REPORTS})
  WHERE ann_date <= DATE '{DAY}') WHERE n = 1""")
def a1(spark: S, d: str) -> DataFrame:
    return P.latest_report(reports(spark, d), DAY, columns=["end_date", "ann_date", "value", "id"], ties=["id"])


@query("a2_latest_non_null", f"""SELECT code, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY end_date DESC, ann_date DESC, id DESC) AS n FROM (SELECT *, CASE WHEN id % 3 = 0 THEN value END AS v FROM ({REPORTS}))
  WHERE ann_date <= DATE '{DAY}' AND v IS NOT NULL) WHERE n = 1""")
def a2(spark: S, d: str) -> DataFrame:
    return P.latest_value(reports(spark, d).withColumn("value", F.when(F.col("id") % 3 == 0, F.col("value"))), DAY, "value", ties=["id"])


# constituents: nations are indices, suppliers their members, a snapshot each quarter
CONS = """SELECT 'I' || s_nationkey AS index_code, DATE '1996-01-01' + CAST(q * 91 AS INTEGER) AS day, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, CASE WHEN (s_suppkey + q) % 37 = 0 THEN -1 ELSE 1 END * abs(s_acctbal) / 1000 AS weight
FROM supplier CROSS JOIN (SELECT unnest(range(12)) AS q) WHERE (s_suppkey + q) % 5 <> 0"""
EXPECTED = "SELECT 'I' || s_nationkey AS index_code, CAST(floor(count(*) * 0.8) AS BIGINT) AS expected FROM supplier GROUP BY 1"
META = f"""SELECT *, CASE WHEN n_duplicates + n_negative + n_bad_codes > 0 THEN 'invalid' WHEN expected IS NULL THEN 'unknown' WHEN n_codes >= expected THEN 'complete' ELSE 'partial' END AS status FROM (
  SELECT index_code, day, count(DISTINCT code) AS n_codes, count(*) - count(DISTINCT code) AS n_duplicates, count(*) FILTER (weight < 0) AS n_negative, 0 AS n_bad_codes FROM ({CONS}) GROUP BY 1, 2) LEFT JOIN ({EXPECTED}) USING (index_code)"""


def constituents(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "supplier").select(F.concat(F.lit("I"), "s_nationkey").alias("index_code"), "s_suppkey", "s_acctbal", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("q"))
    sign = F.when((F.col("s_suppkey") + F.col("q")) % 37 == 0, -1).otherwise(1)
    rows = s.where((F.col("s_suppkey") + F.col("q")) % 5 != 0).select("index_code", F.date_add(F.lit("1996-01-01").cast("date"), F.col("q") * 91).alias("day"), code_of(F.col("s_suppkey")).alias("code"),
                                                                    (sign * F.abs("s_acctbal") / 1000).alias("weight"))
    expected = table(spark, d, "supplier").groupBy(F.concat(F.lit("I"), "s_nationkey").alias("index_code")).agg(F.floor(F.count("*") * 0.8).alias("expected"))
    return rows, expected


@query("a3_snapshot_completeness", f"SELECT index_code, day, n_codes, n_duplicates, n_negative, expected, status FROM ({META})")
def a3(spark: S, d: str) -> DataFrame:
    return P.snapshot_completeness(*constituents(spark, d)).drop("n_bad_codes")


@query("a4_constituents_as_of", f"""WITH m AS ({META}), b AS (SELECT index_code, max(day) AS day FROM m WHERE status = 'complete' AND day <= DATE '1998-02-01' GROUP BY 1) SELECT c.index_code, c.day, c.code, c.weight FROM ({CONS}) c JOIN b USING (index_code, day)""")
def a4(spark: S, d: str) -> DataFrame:
    rows, expected = constituents(spark, d)
    return P.constituents_at(rows, P.snapshot_completeness(rows, expected), "1998-02-01")


@query("a5_constituent_quality", f"SELECT index_code, day, status, w AS weight FROM ({META}) LEFT JOIN (SELECT index_code, day, round(sum(weight), 7) AS w FROM ({CONS}) GROUP BY 1, 2) USING (index_code, day)")
def a5(spark: S, d: str) -> DataFrame:
    rows, expected = constituents(spark, d)
    return P.constituent_quality(rows, P.snapshot_completeness(rows, expected)).select("index_code", "day", "status", F.round("weight", 7).alias("weight"))


# memberships: each security belongs to an industry (nation) over intervals
MEMBERS = """SELECT lpad(CAST(o_custkey % 100 AS VARCHAR), 6, '0') AS code, 'N' || (o_orderkey % 25) AS industry, CAST(o_orderdate AS DATE) AS effective_from,
  CASE WHEN o_orderkey % 50 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) END AS effective_to, o_orderkey AS id FROM orders"""


def members(spark: S, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(code_of(F.col("o_custkey") % 100).alias("code"), F.concat(F.lit("N"), k % 25).alias("industry"), day.alias("effective_from"),
                                           F.when(k % 50 != 3, F.date_add(day, (k % 40).cast("int"))).alias("effective_to"), k.alias("id"))


@query("a6_membership_quality", f"""WITH m AS ({MEMBERS}), o AS (SELECT *, max(coalesce(effective_to, DATE '9999-12-31')) OVER (PARTITION BY code ORDER BY effective_from, coalesce(effective_to, DATE '9999-12-31'), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM m)
SELECT count(*) AS n, count(DISTINCT code) AS codes, count(*) FILTER (until > effective_from) AS overlaps, count(*) FILTER (until = effective_from) AS touching, count(*) FILTER (effective_from > effective_to) AS bad_ranges,
  (SELECT count(*) FROM (SELECT code FROM m WHERE effective_to IS NULL GROUP BY code HAVING count(*) > 1)) AS multi_current, (SELECT count(*) FROM m WHERE industry NOT IN (SELECT 'N' || n_nationkey FROM nation WHERE n_nationkey < 20)) AS orphans FROM o""")
def a6(spark: S, d: str) -> DataFrame:
    kinds = table(spark, d, "nation").where("n_nationkey < 20").select(F.concat(F.lit("N"), "n_nationkey").alias("industry"))
    return P.membership_quality(members(spark, d), kinds)


@query("a7_index_daily_coverage", f"""SELECT n_nationkey AS nation, min(day) AS first_day, max(day) AS last_day, count(b.day) AS n FROM nation LEFT JOIN (SELECT s_nationkey, day FROM ({BARS}) JOIN supplier ON code = lpad(CAST(s_suppkey AS VARCHAR), 6, '0')) b ON n_nationkey = s_nationkey GROUP BY 1""")
def a7(spark: S, d: str) -> DataFrame:
    owner = table(spark, d, "supplier").select(code_of(F.col("s_suppkey")).alias("code"), F.col("s_nationkey").alias("nation"))
    cover = daily_bars(spark, d).join(owner, "code").groupBy("nation").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("nation")).join(cover, "nation", "left").na.fill(0, ["n"])


@query("a9_first_last_bar", f"SELECT code, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM ({BARS}) GROUP BY code")
def a9(spark: S, d: str) -> DataFrame:
    return daily_bars(spark, d).groupBy("code").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n"))


@query("j7_point_in_interval", f"""WITH p AS (SELECT DISTINCT code, ann_date AS day FROM ({REPORTS})), h AS (SELECT p.code, p.day, min(industry) AS lo, max(industry) AS hi FROM p JOIN ({MEMBERS}) m ON p.code = m.code AND m.effective_from <= p.day AND (m.effective_to IS NULL OR m.effective_to >= p.day) GROUP BY 1, 2)
SELECT p.code, p.day, CASE WHEN coalesce(lo <> hi, false) THEN NULL ELSE lo END AS industry, coalesce(lo <> hi, false) AS ambiguous FROM p LEFT JOIN h USING (code, day)""")
def j7(spark: S, d: str) -> DataFrame:
    points = reports(spark, d).select("code", F.col("ann_date").alias("day")).distinct()
    return P.membership_at(members(spark, d), points, "day")


@query("j8_interval_overlaps", f"""SELECT code, count(*) FILTER (until > effective_from) AS overlaps, count(*) FILTER (until = effective_from) AS touches FROM (SELECT *, max(coalesce(effective_to, DATE '9999-12-31')) OVER (PARTITION BY code
  ORDER BY effective_from, coalesce(effective_to, DATE '9999-12-31'), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM ({MEMBERS})) GROUP BY code""")
def j8(spark: S, d: str) -> DataFrame:
    return P.overlaps(members(spark, d), ["code"]).groupBy("code").agg(F.count_if(F.col("meets") == "overlap").alias("overlaps"), F.count_if(F.col("meets") == "touch").alias("touches"))


@query("j9_j10_semi_anti", f"""SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, EXISTS (SELECT 1 FROM ({BARS}) b WHERE b.code = lpad(CAST(c_custkey AS VARCHAR), 6, '0') AND day <= DATE '1996-06-30') AS has_bars FROM customer""")
def j9(spark: S, d: str) -> DataFrame:
    codes = table(spark, d, "customer").select(code_of(F.col("c_custkey")).alias("code"))
    early = daily_bars(spark, d).where(F.col("day") <= "1996-06-30")
    return codes.join(early, "code", "left_semi").withColumn("has_bars", F.lit(True)).unionByName(codes.join(early, "code", "left_anti").withColumn("has_bars", F.lit(False)))


@query("j12_max_then_join", f"SELECT b.code, b.day, b.close FROM ({BARS}) b JOIN (SELECT code, max(day) AS day FROM ({BARS}) WHERE day <= DATE '{DAY}' GROUP BY code) USING (code, day)")
def j12(spark: S, d: str) -> DataFrame:
    from tapeloom.operators.kernels import latest_per_key

    return latest_per_key(daily_bars(spark, d).where(F.col("day") <= DAY), ["code"], ["day"], ["day", "close"])


VALUATION = f"""WITH v AS (SELECT code, arg_max(amount, day) AS circ_mv, max(day) AS valuation_day FROM ({BARS}) WHERE day <= DATE '{DAY}' AND month(day) % 2 = 0 GROUP BY 1), c AS (SELECT code, arg_max(close, day) AS close FROM ({BARS}) WHERE day <= DATE '{DAY}' GROUP BY 1),
s AS (SELECT code, shares AS free_share FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ann_date DESC, end_date DESC, shares DESC) AS n FROM ({REPORTS}) WHERE ann_date <= DATE '{DAY}' AND CAST(code AS INT) % 2 = 0) WHERE n = 1)
SELECT code, circ_mv, valuation_day, close, free_share, round(coalesce(free_share, circ_mv / close), 6) AS a_floats FROM v LEFT JOIN c USING (code) LEFT JOIN s USING (code)"""


def _valuation(spark: S, d: str) -> DataFrame:
    bars = daily_bars(spark, d)
    values = bars.where(F.month("day") % 2 == 0).select("code", "day", F.col("amount").alias("circ_mv"))
    shares = reports(spark, d).where(F.col("code").cast("int") % 2 == 0).withColumnRenamed("shares", "free_share")
    return P.valuation(values, bars, shares, DAY).withColumn("a_floats", F.round("a_floats", 6))


@query("j13_valuation", VALUATION)
def j13(spark: S, d: str) -> DataFrame:
    return _valuation(spark, d)


@query("p11_valuation_screen", f"SELECT code, circ_mv, close FROM ({VALUATION}) WHERE close >= 500 AND circ_mv < 200000 ORDER BY circ_mv DESC, code LIMIT 20")
def p11(spark: S, d: str) -> DataFrame:
    return P.screen(_valuation(spark, d), [("close", ">=", 500), ("circ_mv", "<", 200000), ("unknown", ">", 1)], [("circ_mv", False), ("code", True)], 20).select("code", "circ_mv", "close")


SNAP = f"SELECT code, CAST(code AS INT) % 9 = 0 AS is_st, CAST(code AS INT) % 11 = 0 AS risk, CASE WHEN CAST(code AS INT) % 7 = 0 THEN 1 ELSE 0 END AS suspended, volume FROM ({BARS}) WHERE day = DATE '1997-03-03'"


@query("p12_p13_status", f"""SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, coalesce(is_st, false) OR coalesce(risk, false) AS st, coalesce(suspended = 1 OR volume = 0, false) AS halt, s.code IS NULL AS delisted
FROM supplier LEFT JOIN ({SNAP}) s ON s.code = lpad(CAST(s_suppkey AS VARCHAR), 6, '0')""")
def p12(spark: S, d: str) -> DataFrame:
    k = F.col("code").cast("int")
    snap = daily_bars(spark, d).where(F.col("day") == "1997-03-03").select("code", (k % 9 == 0).alias("is_st"), (k % 11 == 0).alias("is_delisting_risk"), F.when(k % 7 == 0, 1).otherwise(0).alias("suspended"), "volume")
    return P.statuses(table(spark, d, "supplier").select(code_of(F.col("s_suppkey")).alias("code")), snap)


@query("p14_traded_universe", f"SELECT DISTINCT code FROM ({BARS}) WHERE day = (SELECT max(day) FROM ({BARS}) WHERE day <= DATE '{DAY}') AND NOT starts_with(code, '00002')")
def p14(spark: S, d: str) -> DataFrame:
    return P.traded_universe(daily_bars(spark, d), DAY, exclude=("00002",))


@query("p15_p18_listed_universe", f"""WITH b AS (SELECT code, min(day) AS list_date FROM ({BARS}) GROUP BY code) SELECT code FROM b WHERE list_date <= DATE '1995-02-01' AND datediff('day', list_date, DATE '1995-02-01') >= 10""")
def p15(spark: S, d: str) -> DataFrame:
    bars = daily_bars(spark, d)
    basic = bars.groupBy("code").agg(F.min("day").alias("list_date")).withColumn("delist_date", F.lit(None).cast("date"))
    return P.listed_for(P.listed_universe(basic, bars, "1995-02-01"), basic, "1995-02-01", 10).select("code")


@query("p19_recent_halts", f"""WITH r AS (SELECT code, volume, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS n FROM ({BARS}) WHERE day <= DATE '{DAY}') SELECT DISTINCT code FROM r WHERE code NOT IN (SELECT code FROM r WHERE n <= 5 AND volume < 3)""")
def p19(spark: S, d: str) -> DataFrame:
    bars = daily_bars(spark, d).withColumn("volume", F.when(F.col("volume") < 3, 0.0).otherwise(F.col("volume")))
    return P.without_recent_halts(bars.where(F.col("day") <= DAY).select("code").distinct(), bars, DAY, 5)


@query("p22_statement_query", f"SELECT code, end_date, ann_date, value, id FROM ({REPORTS}) WHERE ann_date <= DATE '{DAY}' AND end_date >= DATE '1997-01-01' AND month(end_date) IN (6, 12)")
def p22(spark: S, d: str) -> DataFrame:
    return P.known_reports(reports(spark, d), DAY, "1997-01-01", months=(6, 12)).select("code", "end_date", "ann_date", "value", "id")


@query("p23_security_metadata", f"""WITH f AS (SELECT code, min(day) AS first FROM ({BARS}) GROUP BY code), m AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1994-05-05' END AS list_date, CASE WHEN s_suppkey % 2 = 0 THEN 'stock' ELSE 'etf' END AS asset FROM supplier)
SELECT code, name, asset, coalesce(list_date, first) AS list_date, CASE WHEN list_date IS NOT NULL THEN 'metadata' WHEN first IS NOT NULL THEN 'first_bar' END AS list_date_source FROM m LEFT JOIN f USING (code)""")
def p23(spark: S, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    basic = table(spark, d, "supplier").select(k, code_of(k).alias("code"), F.col("s_name").alias("name"), F.when(k % 3 == 0, F.lit("1994-05-05").cast("date")).alias("list_date"))
    return P.security_metadata(basic.where(k % 2 == 0).drop("s_suppkey"), basic.where(k % 2 == 1).drop("s_suppkey"), daily_bars(spark, d)).select("code", "name", "asset", "list_date", "list_date_source")


@query("p26_fundamentals", f"SELECT code, end_date, ann_date, value FROM ({REPORTS}) WHERE ann_date <= DATE '{DAY}'")
def p26(spark: S, d: str) -> DataFrame:
    return P.fundamentals({"income_statement": reports(spark, d)}, "income_statement", DAY, fields=["value"])


@query("u4_factor_states", f"""WITH m AS (SELECT code, day, factor, lag(factor) OVER (PARTITION BY code ORDER BY day) AS p FROM ({FACTORS})), s AS (SELECT code, max(CASE WHEN p IS NOT NULL AND p <> factor THEN 1 ELSE 0 END) AS c FROM m WHERE day BETWEEN DATE '1995-01-01' AND DATE '1995-02-15' GROUP BY code)
SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, CASE WHEN c IS NULL THEN 'absent' WHEN c = 1 THEN 'changed' ELSE 'stable' END AS state FROM customer LEFT JOIN s ON s.code = lpad(CAST(c_custkey AS VARCHAR), 6, '0')""")
def u4(spark: S, d: str) -> DataFrame:
    return P.changed_stable_absent(table(spark, d, "customer").select(code_of(F.col("c_custkey")).alias("code")), factors(spark, d), "1995-01-01", "1995-02-15")


# adjustment

ADJUSTED = f"""SELECT b.code, b.day, b.close, b.open, b.high, b.low, f.factor, latest, earliest FROM ({BARS}) b ASOF LEFT JOIN ({FACTORS}) f ON b.code = f.code AND b.day >= f.day
LEFT JOIN (SELECT code, arg_max(factor, day) AS latest, arg_min(factor, day) AS earliest FROM ({FACTORS}) GROUP BY code) a ON a.code = b.code"""


@query("q1_anchors", f"SELECT code, arg_max(factor, day) AS latest, arg_min(factor, day) AS earliest FROM ({FACTORS}) GROUP BY code")
def q1(spark: S, d: str) -> DataFrame:
    return A.anchors(factors(spark, d))


@query("q2_adjusted_prices", f"SELECT code, day, round(close * factor / latest, 7) AS close_front, round(close * factor / earliest, 7) AS close_back FROM ({ADJUSTED})")
def q2(spark: S, d: str) -> DataFrame:
    return A.adjust(daily_bars(spark, d), factors(spark, d)).select("code", "day", F.round("close_front", 7).alias("close_front"), F.round("close_back", 7).alias("close_back"))


@query("q3_restore_raw", f"SELECT code, day, round(close, 7) AS close FROM ({BARS})")
def q3(spark: S, d: str) -> DataFrame:
    front = A.adjust(daily_bars(spark, d), factors(spark, d)).select("code", "day", *[f"{p}_front" for p in A.PRICES])
    return A.restore_raw(front, factors(spark, d)).select("code", "day", F.round("close", 7).alias("close"))


@query("q4_factor_normalisation", f"SELECT code, CAST(ts AS DATE) AS day, arg_max(price, ts) AS factor FROM (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS code, ts, value AS price FROM events WHERE value > 0) GROUP BY 1, 2")
def q4(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.concat(code_of(F.col("user_id")), F.lit(".SZ")).alias("code"), F.col("ts").alias("time"), F.col("value").alias("factor"))
    return A.normalize_factors(rows)


@query("q5_revisions", f"""WITH n AS (SELECT * FROM ({FACTORS}) WHERE day <= DATE '1999-12-31'), o AS (SELECT code, day, CASE WHEN CAST(code AS INT) % 5 = 0 THEN factor * 1.01 ELSE factor END AS old FROM ({FACTORS}) WHERE CAST(code AS INT) % 3 <> 0)
SELECT code, CASE WHEN old IS NULL THEN 'new' WHEN abs(factor - old) <= 1e-9 THEN 'unchanged' ELSE 'revised' END AS state, count(*) AS n, round(coalesce(max(abs(factor - old)), 0), 8) AS worst FROM n LEFT JOIN o USING (code, day) GROUP BY 1, 2""")
def q5(spark: S, d: str) -> DataFrame:
    f, k = factors(spark, d), F.col("code").cast("int")
    old = f.where(k % 3 != 0).withColumn("factor", F.when(k % 5 == 0, F.col("factor") * 1.01).otherwise(F.col("factor")))
    return A.revisions(f, old, "1999-12-31").groupBy("code", "state").agg(F.count("*").alias("n"), F.round(F.coalesce(F.max("abs_delta"), F.lit(0.0)), 8).alias("worst"))


@query("q6_observation_ledger", f"""WITH n AS (SELECT * FROM ({FACTORS})), l AS (SELECT code, day, factor AS old FROM ({FACTORS}) WHERE CAST(code AS INT) % 3 <> 0)
SELECT code, day, factor * CASE WHEN CAST(code AS INT) % 5 = 0 THEN 1.01::DOUBLE ELSE 1.0::DOUBLE END AS factor, CASE WHEN old IS NULL THEN 1 ELSE 2 END AS revision_no, old IS NOT NULL AS alert FROM n LEFT JOIN l USING (code, day) WHERE old IS NULL OR CAST(code AS INT) % 5 = 0""")
def q6(spark: S, d: str) -> DataFrame:
    f, k = factors(spark, d), F.col("code").cast("int")
    ledger = f.where(k % 3 != 0).withColumn("revision_no", F.lit(1))
    return A.observe(ledger, f.withColumn("factor", F.col("factor") * F.when(k % 5 == 0, 1.01).otherwise(1.0)), "r2").select("code", "day", "factor", "revision_no", "alert")


@query("q6_factor_events", stages(FACTORS, [{"previous": lag("factor")}], "code, day, factor, previous", "WHERE abs(factor - previous) > 1e-9"))
def q6b(spark: S, d: str) -> DataFrame:
    return A.factor_events(factors(spark, d))


DIVIDENDS = """SELECT lpad(CAST(o_custkey % 100 AS VARCHAR), 6, '0') AS code, CAST(o_orderdate AS DATE) AS ex_date, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS cash_before_tax, o_totalprice * 0.5 AS cash, CASE WHEN o_orderkey % 3 = 0 THEN '预案' ELSE '实施' END AS proc FROM orders"""


def dividends(spark: S, d: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, d, "orders").select(code_of(F.col("o_custkey") % 100).alias("code"), F.col("o_orderdate").cast("date").alias("ex_date"), F.date_sub(F.col("o_orderdate").cast("date"), 10).alias("ann_date"),
                                           F.when(k % 4 != 0, p).alias("cash_before_tax"), (p * 0.5).alias("cash"), F.lit(None).cast("double").alias("stock"), F.when(k % 3 == 0, "预案").otherwise("实施").alias("proc"))


@query("q7_dividend_triggers", f"SELECT code, ex_date, CASE WHEN ex_date > DATE '{DAY}' THEN 'scheduled' ELSE 'pending' END AS state, sha256(code || '|' || ex_date) AS trigger_id FROM ({DIVIDENDS}) WHERE proc = '实施' AND CAST(code AS INT) % 4 <> 0 GROUP BY 1, 2")
def q7(spark: S, d: str) -> DataFrame:
    rows = dividends(spark, d)
    queued = rows.where(F.col("code").cast("int") % 4 == 0).select(F.sha2(F.concat_ws("|", "code", F.col("ex_date").cast("string")), 256).alias("trigger_id")).distinct()
    applied = queued.withColumn("payload_hash", F.lit("none"))
    return A.dividend_triggers(rows, DAY, queued, applied).select("code", "ex_date", "state", "trigger_id")


@query("q18_actions_by_ex_date", f"SELECT code, ex_date, coalesce(cash_before_tax, cash) AS cash, 0.0::DOUBLE AS stock FROM ({DIVIDENDS}) WHERE proc = '实施'")
def q18(spark: S, d: str) -> DataFrame:
    return A.actions_by_ex_date(dividends(spark, d))


def _staged(spark: S, d: str) -> DataFrame:
    k = F.col("code").cast("int") + F.dayofyear("day")
    return daily_bars(spark, d).select("code", "day", *A.PRICES, *[(F.col(p) * 0.8).alias(f"{p}_front") for p in ("open", "high", "close")], F.when(k % 31 == 0, None).when(k % 37 == 0, F.col("low")).otherwise(F.col("low") * 0.8).alias("low_front"))


@query("q8_staging_checks", f"""SELECT code, count(*) FILTER (k % 31 = 0) AS missing, CAST(0 AS BIGINT) AS doubled, CAST(0 AS BIGINT) AS not_positive, count(*) FILTER (k % 31 <> 0 AND k % 37 = 0) AS inconsistent FROM (SELECT code, CAST(code AS INT) + dayofyear(day) AS k FROM ({BARS})) GROUP BY code""")
def q8(spark: S, d: str) -> DataFrame:
    return A.staging_violations(_staged(spark, d))


@query("q10_ratio_segments", f"""WITH r AS (SELECT *, lag(factor) OVER ({BY_CODE}) AS p FROM ({ADJUSTED}) WHERE factor IS NOT NULL), s AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> factor THEN 1 ELSE 0 END) OVER ({BY_CODE} ROWS UNBOUNDED PRECEDING) AS segment FROM r)
SELECT code, CAST(segment AS BIGINT) AS segment, min(day) AS start, max(day) AS "end", count(*) AS n, round(min(factor), 9) AS ratio FROM s GROUP BY 1, 2""")
def q10(spark: S, d: str) -> DataFrame:
    rows = A.factor_on_day(daily_bars(spark, d).select("code", "day"), factors(spark, d)).where(F.col("factor").isNotNull()).withColumnRenamed("factor", "ratio")
    return A.ratio_segments(rows).select("code", "segment", "start", "end", "n", F.round("ratio", 9).alias("ratio"))


@query("q11_unexplained_boundaries", f"SELECT code, day FROM (SELECT code, day, lag(factor) OVER ({BY_CODE}) AS p, factor FROM ({FACTORS})) WHERE p IS NOT NULL AND p <> factor AND month(day) <> 1")
def q11(spark: S, d: str) -> DataFrame:
    rows = A.factor_on_day(daily_bars(spark, d).select("code", "day"), factors(spark, d)).where(F.col("factor").isNotNull()).withColumnRenamed("factor", "ratio")
    return A.unexplained_boundaries(A.ratio_segments(rows), factors(spark, d).where(F.month("day") == 1))


@query("q12_q13_apply_segments", f"SELECT code, count(*) AS samples, true AS ok FROM ({ADJUSTED}) WHERE factor IS NOT NULL GROUP BY code")
def q12(spark: S, d: str) -> DataFrame:
    bars = A.factor_on_day(daily_bars(spark, d), factors(spark, d)).where(F.col("factor").isNotNull())
    seg = A.ratio_segments(bars.select("code", "day", F.col("factor").alias("ratio")))
    stored = bars.select("code", "day", *[F.col(p).alias(f"{p}_front") for p in A.PRICES])
    return A.golden_check(A.apply_segments(stored, seg), stored, seg).select("code", "samples", "ok")


@query("j18_diff_tables", f"""SELECT 'close' AS "column", count(*) FILTER (k % 31 = 0) AS different, 0 AS one_null, 1.0::DOUBLE AS max_abs FROM (SELECT CAST(code AS INT) + dayofyear(day) AS k FROM ({BARS}))
UNION ALL SELECT 'volume', 0, count(*) FILTER (k % 29 = 0), 0.0::DOUBLE FROM (SELECT CAST(code AS INT) + dayofyear(day) AS k FROM ({BARS}))""")
def j18(spark: S, d: str) -> DataFrame:
    k, bars = F.col("code").cast("int") + F.dayofyear("day"), daily_bars(spark, d)
    other = bars.select("code", "day", F.when(k % 31 == 0, F.col("close") + 1.0).otherwise(F.col("close")).alias("close"), F.when(k % 29 != 0, F.col("volume")).alias("volume"))
    return A.diff_tables(bars, other, ["code", "day"], ["close", "volume"]).select("column", "different", "one_null", F.round("max_abs", 6).alias("max_abs"))


@query("j17_q24_changed_rows", f"SELECT code, day FROM ({BARS}) WHERE (CAST(code AS INT) + dayofyear(day)) % 29 = 0 OR (CAST(code AS INT) + dayofyear(day)) % 31 = 0")
def j17(spark: S, d: str) -> DataFrame:
    k, bars = F.col("code").cast("int") + F.dayofyear("day"), daily_bars(spark, d).select("code", "day", "close", "volume")
    old = bars.where(k % 31 != 0).withColumn("volume", F.when(k % 29 != 0, F.col("volume")))
    return A.changed_rows(bars, old, ["code", "day"]).select("code", "day")


@query("q16_split_merge", stages(f"SELECT *, lead(close) OVER ({BY_CODE}) AS nc FROM ({BARS})", [{"pc": lag("close")}, {"ratio": "pc / open"}],
       "code, CASE WHEN ratio < 0.99 THEN 'merge' WHEN ratio <= 1.01 THEN 'none' WHEN ratio < 1.10 THEN 'cash' ELSE 'split' END AS kind, count(*) AS n", "WHERE ratio IS NOT NULL GROUP BY 1, 2"))
def q16(spark: S, d: str) -> DataFrame:
    return A.split_merge_events(daily_bars(spark, d), "open").groupBy("code", "kind").agg(F.count("*").alias("n"))


@query("q17_price_moves", stages(BARS, [{"gap": f"abs(open / {lag('close')} - 1)"}], "code, day, round(gap, 8) AS gap, gap <= 0.503 AS edge", "WHERE gap > 0.497"))
def q17(spark: S, d: str) -> DataFrame:
    return A.price_moves(daily_bars(spark, d), 0.5, previous_close="open").select("code", "day", F.round("gap", 8).alias("gap"), "edge")


@query("q17_halted_days", f"""WITH d AS (SELECT DISTINCT day FROM ({BARS})), p AS (SELECT code, min(day) AS a, min(day) + 60 AS z FROM ({BARS}) GROUP BY code) SELECT p.code, d.day FROM p JOIN d ON d.day >= a AND d.day < z ANTI JOIN ({BARS}) b ON b.code = p.code AND b.day = d.day""")
def q17b(spark: S, d: str) -> DataFrame:
    bars = daily_bars(spark, d)
    pool = bars.groupBy("code").agg(F.min("day").alias("list_date")).withColumn("delist_date", F.date_add("list_date", 60))
    return A.halted_days(pool, bars, bars)


@query("q19_fill_eps", f"""WITH t AS (SELECT code, end_date, max(ann_date) AS ann_date FROM ({REPORTS}) GROUP BY 1, 2), i AS (SELECT code, end_date, ann_date, value AS eps FROM (SELECT *, row_number() OVER (PARTITION BY code, end_date ORDER BY ann_date DESC, value DESC) AS n FROM ({REPORTS}) WHERE id % 2 = 0) WHERE n = 1)
SELECT t.code, t.end_date, greatest(t.ann_date, coalesce(i.ann_date, t.ann_date)) AS ann_date, i.eps, CASE WHEN i.eps IS NOT NULL THEN 'income_statement' END AS eps_source FROM t LEFT JOIN i USING (code, end_date)""")
def q19(spark: S, d: str) -> DataFrame:
    rep = reports(spark, d)
    target = rep.groupBy("code", "end_date").agg(F.max("ann_date").alias("ann_date")).withColumn("eps", F.lit(None).cast("double"))
    return A.fill_eps(target, rep.where("id % 2 = 0").select("code", "end_date", "ann_date", F.col("value").alias("eps")))


@query("q22_risk_flags", f"SELECT code, day, close < 300 AND amount < 2000 AS both_low, CASE WHEN close < 1 AND amount < 2000 THEN 'both' WHEN close < 1 THEN 'price' WHEN amount < 2000 THEN 'market_cap' ELSE 'none' END AS source, year(day) = 1996 AS is_st FROM ({BARS})")
def q22(spark: S, d: str) -> DataFrame:
    bars = daily_bars(spark, d)
    got = A.risk_flags(bars, bars.where(F.year("day") == 1996), bars.where(F.col("amount") < 2000))
    return got.select("code", "day", ((F.col("close") < 300) & (F.col("amount") < 2000)).alias("both_low"), "source", "is_st")


@query("w4_percent_change", stages(BARS, [{"raw": f"(close / {lag('close')} - 1) * 100"}, {"said": "CASE WHEN CAST(code AS INT) % 2 = 0 THEN amount / 100 END"}],
       "code, day, round(CASE WHEN said IS NULL THEN raw WHEN abs(said) > 200 AND abs(raw) < 30 THEN raw WHEN abs(said) > 200 THEN NULL ELSE said END, 6) AS pct_chg"))
def w4(spark: S, d: str) -> DataFrame:
    got = A.chained_change(daily_bars(spark, d), F.when(F.col("code").cast("int") % 2 == 0, F.col("amount") / 100))
    return got.select("code", "day", F.round("pct_chg", 6).alias("pct_chg"))


@query("w13_gap_to_next_factor", f"""WITH d AS (SELECT day, row_number() OVER (ORDER BY day) AS pos FROM (SELECT DISTINCT day FROM ({BARS}))) SELECT code, day, lead(pos) OVER ({BY_CODE}) - pos AS gap FROM ({FACTORS}) JOIN d USING (day)""")
def w13(spark: S, d: str) -> DataFrame:
    from tapeloom.operators.calendar import indexed

    pos = indexed(daily_bars(spark, d)).select("day", F.col("pos").cast("long").alias("pos"))
    w = Window.partitionBy("code").orderBy("day")
    return factors(spark, d).join(pos, "day").select("code", "day", (F.lead("pos").over(w) - F.col("pos")).alias("gap"))
