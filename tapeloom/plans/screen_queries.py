"""Queries of the factor jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import screen as X
from tapeloom.plans.base import BY_CODE, lag, over, query, rolled, stages
from tapeloom.sources.testmap import BARS, REPORTS, code_of, daily_bars, reports, table

S = SparkSession


@query("x1_momentum_top", stages(BARS, [{"score": f"close / {lag('close', 2)} - 1"}, {"rank": "row_number() OVER (PARTITION BY day ORDER BY score DESC NULLS LAST, code)"}], "day, code, round(score, 8) AS score, CAST(rank AS INTEGER) AS rank", "WHERE rank <= 2 AND score IS NOT NULL"))
def x1(spark: S, d: str) -> DataFrame:
    return X.momentum_top(daily_bars(spark, d)).withColumn("score", F.round("score", 8))


def _pct(x: str) -> str:
    return f"(rank() OVER (PARTITION BY day ORDER BY {x}) + (count(*) OVER (PARTITION BY day, {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY day)"


@query("x2_theme_rotation", stages(BARS, [{"amt": rolled("avg", "amount", 20)} | {f"ma{n}": rolled("avg", "close", n) for n in (5, 10, 20, 60)} | {f"m{n}": f"close / {lag('close', n)} - 1" for n in (5, 10, 20)}], "*")
       .replace("SELECT * FROM t1", f"""SELECT day, code, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(score, 9) DESC, code) AS rank FROM (SELECT *, 0.6 * ({_pct('m5')} + {_pct('m10')} + {_pct('m20')}) / 3 +
  0.4 * CASE WHEN ma5 > ma10 AND ma10 > ma20 AND ma20 > ma60 THEN 1.0 ELSE 0.0 END AS score FROM t1 WHERE amt >= 20000 AND m20 IS NOT NULL AND ma60 IS NOT NULL)) WHERE rank <= 5"""))
def x2(spark: S, d: str) -> DataFrame:
    return X.theme_rotation(daily_bars(spark, d), 20000).withColumn("score", F.round("score", 6))


@query("x3_worst_performers", stages(BARS, [{"score": f"close / {lag('close', 250)} - 1", "rise": f"close / ({rolled('min', 'low', 20)}) - 1"}, {"rank": "row_number() OVER (PARTITION BY day ORDER BY score NULLS LAST, code)"}],
       "day, code, round(score, 8) AS score, rise >= 0.25 AS take_profit, CAST(rank AS INTEGER) AS rank", "WHERE rank <= 18 AND score IS NOT NULL"))
def x3(spark: S, d: str) -> DataFrame:
    return X.worst_performers(daily_bars(spark, d)).withColumn("score", F.round("score", 8))


def _candidates(spark: S, d: str) -> DataFrame:
    k = F.col("code").cast("int") + F.dayofyear("day")
    s = X.Series(daily_bars(spark, d))
    s.let(mc20=F.col("close") / s.ref("close", 20) - 1, mc112=F.col("close") / s.ref("close", 112) - 1)
    return s.df.select("day", "code", F.col("_i").alias("age"), (k % 11 != 0).alias("tradable"), (k % 101).cast("double").alias("growth"), F.col("amount").alias("cap"), (k % 7 - 1).cast("double").alias("eps"), "mc112", "mc20")


def _clip(x: str, name: str) -> str:
    """SQL that adds ``name``: ``x`` clipped to its (k + 1)th values from below and above within the day, k = 5 % of those there are."""
    k = f"floor(count({x}) OVER (PARTITION BY day) * 0.05::DOUBLE)"
    return (f"SELECT *, CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, max(CASE WHEN down_ = k_ + 1 THEN {x} END) OVER (PARTITION BY day)), max(CASE WHEN up_ = k_ + 1 THEN {x} END) OVER (PARTITION BY day)) END AS {name} "
            f"FROM (SELECT * EXCLUDE (k_, up_, down_), {k} AS k_, row_number() OVER (PARTITION BY day ORDER BY {x} NULLS LAST) AS up_, row_number() OVER (PARTITION BY day ORDER BY {x} DESC NULLS LAST) AS down_ FROM (%s))")


def _rank_mean(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY day ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY day, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY day) END"


_FUNNEL = f"""WITH c AS (SELECT day, code, amount, row_number() OVER ({BY_CODE}) AS age, CAST(code AS INT) + dayofyear(day) AS k, close / lag(close, 20) OVER ({BY_CODE}) - 1 AS mc20, close / lag(close, 112) OVER ({BY_CODE}) - 1 AS mc112 FROM ({BARS})),
t AS (SELECT * FROM c WHERE age >= 25 AND k % 11 <> 0), g AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY k % 101 DESC, code) AS r, count(*) OVER (PARTITION BY day) AS n FROM t), h AS (SELECT * FROM g WHERE r <= greatest(1, floor(n * 0.5))),
s AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY amount, code) AS q FROM h), e AS (SELECT *, 0 AS k_, 0 AS up_, 0 AS down_ FROM s WHERE q <= 30 AND k % 7 - 1 > 0), """


@query("x4_growth_funnel", _FUNNEL + f"""w1 AS ({_clip("mc112", "w112") % "SELECT * FROM e"}), w2 AS ({_clip("mc20", "w20") % "SELECT * FROM w1"}), z AS (SELECT *, {_rank_mean("w112")} + {_rank_mean("w20")} AS score FROM w2)
SELECT day, code, round(score, 8) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(score, 9) DESC NULLS LAST, amount, code) AS rank FROM z) WHERE rank <= 10""")
def x4(spark: S, d: str) -> DataFrame:
    return X.growth_funnel(_candidates(spark, d), 0.5)[0].withColumn("score", F.round("score", 8))


@query("x4_funnel_counts", f"""WITH c AS (SELECT day, code, row_number() OVER ({BY_CODE}) AS age, CAST(code AS INT) + dayofyear(day) AS k, amount FROM ({BARS})), t AS (SELECT * FROM c WHERE age >= 25 AND k % 11 <> 0),
g AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY k % 101 DESC, code) AS r, count(*) OVER (PARTITION BY day) AS n FROM t), h AS (SELECT * FROM g WHERE r <= greatest(1, floor(n * 0.5))),
s AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY amount, code) AS q FROM h), e AS (SELECT * FROM s WHERE q <= 30 AND k % 7 - 1 > 0)
SELECT c.day, count(*) AS "all", (SELECT count(*) FROM t WHERE t.day = c.day) AS tradable, (SELECT count(*) FROM h WHERE h.day = c.day) AS grown, (SELECT count(*) FROM e WHERE e.day = c.day) AS earning FROM c GROUP BY c.day""")
def x4b(spark: S, d: str) -> DataFrame:
    return X.growth_funnel(_candidates(spark, d), 0.5)[1]


@query("x5_four_factor_weights")
def x5(spark: S, d: str) -> DataFrame:
    return X.four_factor_weights(daily_bars(spark, d))


@query("x6_regime_switch", f"""WITH m AS (SELECT code, CAST(date_trunc('month', day) AS DATE) AS month, arg_max(close, day) AS close FROM ({BARS}) GROUP BY 1, 2), l AS (SELECT *, lag(close, 1) OVER (PARTITION BY code ORDER BY month) AS p1, lag(close, 12) OVER (PARTITION BY code ORDER BY month) AS p12 FROM m),
s AS (SELECT *, CASE WHEN month(month) % 3 = 0 THEN 'reversal' ELSE 'momentum' END AS regime FROM l), q AS (SELECT *, CASE WHEN regime = 'reversal' THEN -(close / p1 - 1) ELSE p1 / p12 - 1 END AS score FROM s)
SELECT month, code, regime, round(score, 8) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, code) AS rank FROM q WHERE score IS NOT NULL) WHERE rank <= 5""")
def x6(spark: S, d: str) -> DataFrame:
    bars = daily_bars(spark, d)
    regimes = bars.select(F.trunc("day", "month").alias("month")).distinct().withColumn("regime", F.when(F.month("month") % 3 == 0, "reversal").otherwise("momentum"))
    return X.regime_switch(bars, regimes).withColumn("score", F.round("score", 8))


@query("x7_eight_factors", stages(BARS, [{"dd": f"close - {lag('close')}", "f1": f"close / {lag('close', 20)} - 1", "ma200": rolled("avg", "close", 200), "v5": rolled("avg", "volume", 5), "v20": rolled("avg", "volume", 20), "top60": rolled("max", "high", 60)}],
       "code, day, round(f1, 8) AS f1, round(v5 / v20, 6) AS f3, round(close / top60, 8) AS f6, close < 0.97 * ma200 AS below_trend"))
def x7(spark: S, d: str) -> DataFrame:
    return X.eight_factors(daily_bars(spark, d)).select("code", "day", F.round("f1", 8).alias("f1"), F.round("f3", 6).alias("f3"), F.round("f6", 8).alias("f6"), "below_trend")


def _less(x: str) -> str:
    """A smaller-values share within the day, 0 for missing values and lone rows."""
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER (PARTITION BY day) > 1 THEN (rank() OVER (PARTITION BY day ORDER BY {x} NULLS LAST) - 1)::DOUBLE / (count({x}) OVER (PARTITION BY day) - 1) ELSE 0e0 END"


_F = ("f1", "f2", "f3", "f6", "f8")


@query("x7_scores", stages(BARS, [{"dd": f"close - {lag('close')}", "f1": f"close / {lag('close', 20)} - 1", "r60": f"close / {lag('close', 60)} - 1", "v5": rolled("avg", "volume", 5), "v20": rolled("avg", "volume", 20), "a5": rolled("avg", "amount", 5),
       "a20": rolled("avg", "amount", 20), "top60": rolled("max", "high", 60)} | {f"ma{n}": rolled("avg", "close", n) for n in (5, 10, 20, 60)},
       {"sd": rolled("stddev_pop", "dd", 60)}, {"f2": "r60 / nullif(sd, 0)", "f3": "v5 / v20", "f6": "close / top60", "f8": "((ma5 > ma10)::INT + (ma10 > ma20)::INT + (ma20 > ma60)::INT)::DOUBLE"},
       {"score": " + ".join(f"({_less(f)})" for f in _F), "high_share": "avg((close >= top60)::INT) OVER (PARTITION BY day)"}],
       "day, code, round(score, 8) AS score, a5 < 0.7 * a20 AS contracting, round(high_share, 8) AS new_high_share"))
def x7b(spark: S, d: str) -> DataFrame:
    return X.eight_factors(daily_bars(spark, d)).select("day", "code", F.round("score", 8).alias("score"), "contracting", F.round("new_high_share", 8).alias("new_high_share"))


@query("k3_buffer_band", f"""WITH RECURSIVE t AS (SELECT code, day, close / lag(close, 20) OVER (PARTITION BY code ORDER BY day) - 1 AS score FROM ({BARS})), k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, code) AS rank FROM t WHERE score IS NOT NULL),
p AS MATERIALIZED (SELECT 'y' || year(day) AS strategy, day, list(code ORDER BY rank) AS codes, row_number() OVER (PARTITION BY year(day) ORDER BY day) AS i FROM k WHERE rank <= 8 GROUP BY day),
r AS (SELECT strategy, i, day, codes[1:5] AS held FROM p WHERE i = 1 UNION ALL SELECT strategy, i, day, kept || CASE WHEN len(kept) < 5 THEN list_filter(codes, lambda c: NOT list_contains(kept, c))[1:5 - len(kept)] ELSE [] END
  FROM (SELECT p.*, list_filter(r.held, lambda c: list_contains(p.codes, c)) AS kept FROM r JOIN p ON p.strategy = r.strategy AND p.i = r.i + 1))
SELECT strategy, day, unnest(held) AS code FROM r""")
def k3(spark: S, d: str) -> DataFrame:
    ranks = X.momentum_top(daily_bars(spark, d), 20, 8).select(F.concat(F.lit("y"), F.year("day")).alias("strategy"), "day", "code", "rank")
    return X.buffer_band(ranks)


@query("x8_first_board_pullback", stages(BARS, [{"i": f"row_number() OVER ({BY_CODE})", "pc": lag("close")}, {"up": "round(pc * 1.1, 2)"}, {"sealed": "close >= up - 0.002 * pc AND high > low"}, {"first": f"sealed AND NOT coalesce({lag('sealed')}, false)"},
       {"bi": over("max(CASE WHEN first THEN i END)", "ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING")}], "day, code, i - bi AS bars_since", "WHERE bi IS NOT NULL"))
def x8(spark: S, d: str) -> DataFrame:
    return X.first_board_pullback(daily_bars(spark, d)).select("day", "code", "bars_since")


@query("x9_sentiment_phase", f"""WITH r AS (SELECT *, {lag('close')} AS pc FROM ({BARS})), g AS (SELECT day, count(*) FILTER (close >= pc * (1 + 0.1::DOUBLE) * 0.998) AS boards, count(*) FILTER (high >= pc * (1 + 0.1::DOUBLE) * 0.998) AS touched FROM r GROUP BY day),
s AS (SELECT *, avg(boards) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS sma3 FROM g), t AS (SELECT *, lag(sma3) OVER (ORDER BY day) AS before, 1 - boards / nullif(touched, 0) AS broken FROM s)
SELECT day, boards, round(sma3, 6) AS sma3, round(broken, 6) AS broken, CASE WHEN sma3 < 1 THEN 'ice' WHEN sma3 < before AND coalesce(broken, 0) > 0.5 THEN 'decay' WHEN sma3 > 2 * before THEN 'climax' WHEN sma3 > before THEN 'expand' ELSE 'recover' END AS phase FROM t""")
def x9(spark: S, d: str) -> DataFrame:
    return X.sentiment_phase(daily_bars(spark, d)).withColumn("sma3", F.round("sma3", 6)).withColumn("broken", F.round("broken", 6))


@query("x10_sector_heat", stages(BARS, [{"ret": f"close / {lag('close', 5)} - 1"}], "*").replace("SELECT * FROM t1", """, h AS (SELECT day, s_nationkey AS sector, avg(ret) AS ret FROM t1 JOIN supplier ON code = lpad(CAST(s_suppkey AS VARCHAR), 6, '0') WHERE ret IS NOT NULL GROUP BY 1, 2)
SELECT day, sector, round(ret, 6) AS ret, round(cume_dist() OVER (PARTITION BY day ORDER BY ret), 8) AS heat FROM h"""))
def x10(spark: S, d: str) -> DataFrame:
    sectors = table(spark, d, "supplier").select(code_of(F.col("s_suppkey")).alias("code"), F.col("s_nationkey").alias("sector"))
    return X.sector_heat(daily_bars(spark, d), sectors).withColumn("ret", F.round("ret", 6)).withColumn("heat", F.round("heat", 8))


@query("x11_overnight_features", f"""WITH RECURSIVE p AS MATERIALIZED (SELECT *, row_number() OVER ({BY_CODE}) AS i, {rolled("max", "high", 4)} AS h4, {rolled("min", "low", 4)} AS l4, row_number() OVER (PARTITION BY day ORDER BY amount, code) AS n FROM ({BARS})),
r AS (SELECT code, i, close AS e FROM p WHERE i = 1 UNION ALL SELECT p.code, p.i, r.e + (p.close - r.e) / 3e0 FROM r JOIN p ON p.code = r.code AND p.i = r.i + 1)
SELECT day, code, round((h4 - l4) / l4, 7) AS amp, round(e, 5) AS ema5, row_number() OVER (PARTITION BY day ORDER BY amount, code)::INTEGER AS rank FROM p JOIN r USING (code, i) WHERE n <= 10 AND (h4 - l4) / l4 <= 5.0 AND close > e""")
def x11(spark: S, d: str) -> DataFrame:
    return X.overnight_features(daily_bars(spark, d), 10, 5.0).withColumns({"amp": F.round("amp", 7), "ema5": F.round("ema5", 5)})


@query("x12_bbi_rotation", stages(BARS, [{f"m{n}": rolled("avg", "close", n) for n in (3, 6, 12, 20)} | {"change": f"close / {lag('close')} - 1"}, {"ratio": "(m3 + m6 + m12 + m20) / 4 / close"}], "*").replace("SELECT * FROM t2", """,
u AS (SELECT day FROM t2 WHERE code IN ('000001', '000002') GROUP BY day HAVING max(change) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ratio, code) AS n FROM t2 WHERE code NOT IN ('000001', '000002') AND ratio IS NOT NULL AND day IN (SELECT day FROM u))
SELECT day, code, round(ratio, 7) AS ratio FROM r WHERE n = 1 AND ratio < 1"""))
def x12(spark: S, d: str) -> DataFrame:
    return X.bbi_rotation(daily_bars(spark, d), ["000001", "000002"]).withColumn("ratio", F.round("ratio", 7))


@query("x13_event_selection", f"""WITH b AS (SELECT *, {lag('close')} AS pc, min(day) OVER (PARTITION BY code) AS list_date FROM ({BARS})), e AS (SELECT ann_date AS day, code, id AS seq FROM ({REPORTS}) WHERE id % 4 IN (1, 2)),
j AS (SELECT e.day, e.code, e.seq, s_nationkey AS industry FROM e JOIN b USING (day, code) JOIN supplier ON e.code = lpad(CAST(s_suppkey AS VARCHAR), 6, '0') WHERE pc IS NOT NULL AND open < pc * 1.098 AND datediff('day', list_date, e.day) >= 365 AND CAST(e.code AS INT) % 9 <> 0),
i AS (SELECT *, row_number() OVER (PARTITION BY day, industry ORDER BY seq, code) AS n FROM j), k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY seq, code) AS rank FROM i WHERE n <= 2) SELECT day, code, industry, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def x13(spark: S, d: str) -> DataFrame:
    bars = daily_bars(spark, d)
    events = reports(spark, d).select(F.col("ann_date").alias("day"), "code", (F.col("id") % 4).cast("string").alias("rating"), F.col("id").alias("seq"))
    first = bars.groupBy("code").agg(F.min("day").alias("list_date"))
    status = bars.select("day", "code", (F.col("code").cast("int") % 9 == 0).alias("st")).join(first, "code")
    industries = table(spark, d, "supplier").select(code_of(F.col("s_suppkey")).alias("code"), F.col("s_nationkey").alias("industry"))
    return X.event_selection(events, bars, status, industries, ["1", "2"])
