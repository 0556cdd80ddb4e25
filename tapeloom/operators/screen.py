"""Cross-sectional factor jobs: scores and selections for all dates in one plan.

Each takes a bar table (and what else it needs) and returns rows of
(day, code, score, rank) or the features behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.indicators import Series, bbi, ema, recursive
from tapeloom.operators.kernels import fold, percent_less, percent_rank_average, winsorize


def ranked(df: DataFrame, n: int, *order: Column, by: Sequence[str] = ("day",)) -> DataFrame:
    """First ``n`` of each day in a full order (K1)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def momentum_top(bars: DataFrame, lookback: int = 2, n: int = 2) -> DataFrame:
    """Strongest change over ``lookback`` bars."""
    s = Series(bars)
    df = s.let(score=F.col("close") / s.ref("close", lookback) - 1).df.where(F.col("score").isNotNull())
    return ranked(df, n, F.desc("score"), F.col("code")).select("day", "code", "score", "rank")


def theme_rotation(bars: DataFrame, least_amount: float = 1e6, n: int = 5) -> DataFrame:
    """Liquid securities by mean momentum percentile (0.6) and moving-average order (0.4)."""
    s = Series(bars)
    s.let(amt=s.ma("amount", 20), ma5=s.ma("close", 5), ma10=s.ma("close", 10), ma20=s.ma("close", 20), ma60=s.ma("close", 60))
    s.let(**{f"m{k}": F.col("close") / s.ref("close", k) - 1 for k in (5, 10, 20)})
    df = s.df.where((F.col("amt") >= least_amount) & F.col("m20").isNotNull() & F.col("ma60").isNotNull())
    df = df.withColumns({f"p{k}": percent_rank_average(F.col(f"m{k}"), ["day"]) for k in (5, 10, 20)})
    order = ((F.col("ma5") > F.col("ma10")) & (F.col("ma10") > F.col("ma20")) & (F.col("ma20") > F.col("ma60"))).cast("double")
    df = df.withColumn("score", 0.6 * (F.col("p5") + F.col("p10") + F.col("p20")) / 3 + 0.4 * order)
    return ranked(df, n, F.desc(F.round("score", 9)), F.col("code")).select("day", "code", "score", "rank")


def worst_performers(bars: DataFrame, lookback: int = 250, n: int = 18) -> DataFrame:
    """Lowest return over a long look-back, with the rise from the 20-day low that ends a holding."""
    s = Series(bars)
    s.let(score=F.col("close") / s.ref("close", lookback) - 1, rise=F.col("close") / s.llv("low", 20) - 1)
    return ranked(s.df.where(F.col("score").isNotNull()), n, F.asc("score"), F.col("code")).select("day", "code", "score", (F.col("rise") >= 0.25).alias("take_profit"), "rank")


def growth_funnel(candidates: DataFrame, top_growth: float = 0.1, smallest: int = 30, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Growth's top share, the smallest of them by value, positive earnings, then winsorised momentum ranks.

    ``candidates``: day, code, age, tradable, growth, cap, eps, mc112, mc20.
    Returns the selection and the funnel's counts per day.
    """
    w = Window.partitionBy("day")
    df = candidates.where((F.col("age") >= 25) & F.col("tradable"))
    df = df.withColumn("_g", F.row_number().over(w.orderBy(F.desc_nulls_last("growth"), "code"))).withColumn("_n", F.count("growth").over(w))
    grown = df.where(F.col("growth").isNotNull() & (F.col("_g") <= F.greatest(F.lit(1), F.floor(F.col("_n") * top_growth))))
    small = ranked(grown, smallest, F.asc("cap"), F.col("code")).drop("rank")
    earning = small.where(F.col("eps") > 0)
    scored = winsorize(winsorize(earning, "mc112", ["day"], 0.05, "w112"), "mc20", ["day"], 0.05, "w20")
    scored = scored.withColumn("score", percent_rank_average(F.col("w112"), ["day"]) + percent_rank_average(F.col("w20"), ["day"]))
    counts = (candidates.groupBy("day").agg(F.count("*").alias("all"), F.count_if((F.col("age") >= 25) & F.col("tradable")).alias("tradable"))
              .join(grown.groupBy("day").agg(F.count("*").alias("grown")), "day", "left").join(earning.groupBy("day").agg(F.count("*").alias("earning")), "day", "left").na.fill(0))
    return ranked(scored, n, F.desc(F.round("score", 9)), F.asc("cap"), F.col("code")).select("day", "code", "score", "rank"), counts


def min_variance(matrix: np.ndarray, floor: float, ridge: float = 1e-8) -> np.ndarray:
    """Long-only weights of least variance, blended towards the best mean until the mean reaches ``floor``."""
    k = matrix.shape[0]
    cov = np.atleast_2d(np.cov(matrix)) + ridge * np.eye(k)
    mean = matrix.mean(1)
    w = np.linalg.solve(cov, np.ones(k))
    w = np.clip(w / w.sum(), 0, None)
    w = w / w.sum() if w.sum() > 0 else np.full(k, 1 / k)
    have, best = float(w @ mean), float(mean.max())
    if have < floor and best > have:
        share = min(1.0, (floor - have) / (best - have))
        w = (1 - share) * w + share * (mean == best) / (mean == best).sum()
    return w / w.sum()


def four_factor_weights(bars: DataFrame, lookback: int = 60, k: int = 5, floor: float = 0.0005) -> DataFrame:
    """Return, Sharpe, win rate and drawdown percentiles pick ``k`` at each month's end; weights of least variance.

    A group is one month's ``k`` securities, so its size is fixed.
    """
    s = Series(bars)
    s.let(r=F.col("close") / s.ref("close") - 1)
    s.let(mean=s.ma("r", lookback), sd=s.std("r", lookback), wins=s.ma((F.col("r") > 0).cast("double"), lookback), peak=s.hhv("close", lookback))
    s.let(full=F.count("r").over(s.w.rowsBetween(-(lookback - 1), 0)), mdd=s.llv((F.col("close") / F.col("peak") - 1), lookback))
    df = s.df.where((F.col("sd") > 0) & F.col("mdd").isNotNull() & (F.col("full") == lookback))
    last = df.withColumn("month", F.trunc("day", "month")).withColumn("_l", F.max("day").over(Window.partitionBy("code", F.col("month")))).where("day = _l")
    by = ["month"]
    score = sum((percent_rank_average(c, by) for c in (F.col("mean") / F.col("sd"), F.col("wins"), F.col("mdd"))), percent_rank_average(F.col("mean"), by))
    top = ranked(last.withColumn("score", score), k, F.desc(F.round("score", 9)), F.col("code"), by=by).select("month", "code", "score", F.col("_i").alias("until"))
    # only the chosen securities' returns are gathered: every one meets the months whose look-back holds it
    moves = s.df.where(F.col("r").isNotNull()).select("code", F.col("_i").alias("at"), "r")
    past = (top.select("month", "code", "score", F.explode(F.sequence(F.col("until") - lookback + 1, F.col("until"))).alias("at")).join(moves, ["code", "at"])
            .groupBy("month", "code", "score").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda x: x["r"]).alias("past")))

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        f["weight"] = min_variance(np.stack(f["past"].to_list()), floor)
        return f[["month", "code", "score", "weight"]]

    return fold(past, ["month"], ["code"], solve, "month date, code string, score double, weight double")


def regime_switch(bars: DataFrame, regimes: DataFrame, n: int = 5) -> DataFrame:
    """Monthly momentum (T-1 over T-12) or reversal (T over T-1) by regime (X6). ``regimes``: month, regime."""
    month = bars.groupBy("code", F.trunc("day", "month").alias("month")).agg(F.max_by("close", "day").alias("close"))
    s = Series(month, order="month")
    s.let(momentum=s.ref("close", 1) / s.ref("close", 12) - 1, reversal=-(F.col("close") / s.ref("close", 1) - 1))
    df = s.df.join(regimes.select("month", "regime"), "month").withColumn("score", F.when(F.col("regime") == "reversal", F.col("reversal")).otherwise(F.col("momentum")))
    return ranked(df.where(F.col("score").isNotNull()), n, F.desc("score"), F.col("code"), by=["month"]).select("month", "code", "regime", "score", "rank")


def eight_factors(bars: DataFrame) -> DataFrame:
    """Industry rotation: the window factors' percentiles, their sum and the bear signals.

    F2 divides the 60-day return by the deviation of price differences, not of
    returns, as its source does.
    """
    s = Series(bars)
    s.let(d=s.diff("close"), f1=F.col("close") / s.ref("close", 20) - 1, ma5=s.ma("close", 5), ma10=s.ma("close", 10), ma20=s.ma("close", 20), ma60=s.ma("close", 60), ma200=s.ma("close", 200),
          v5=s.ma("volume", 5), v20=s.ma("volume", 20), a5=s.ma("amount", 5), a20=s.ma("amount", 20), top60=s.hhv("high", 60))
    s.let(f2=(F.col("close") / s.ref("close", 60) - 1) / F.when(s.std("d", 60) != 0, s.std("d", 60)), f3=F.col("v5") / F.col("v20"), f6=F.col("close") / F.col("top60"),
          f8=((F.col("ma5") > F.col("ma10")).cast("int") + (F.col("ma10") > F.col("ma20")).cast("int") + (F.col("ma20") > F.col("ma60")).cast("int")).cast("double"))
    names = ("f1", "f2", "f3", "f6", "f8")
    df = s.df.withColumns({f"r_{f}": percent_less(F.col(f), ["day"]) for f in names})
    df = df.withColumn("score", sum((F.col(f"r_{f}") for f in names[1:]), F.col(f"r_{names[0]}")))
    w = Window.partitionBy("day")
    return df.withColumns({"contracting": F.col("a5") < 0.7 * F.col("a20"), "below_trend": F.col("close") < 0.97 * F.col("ma200"), "new_high_share": F.avg((F.col("close") >= F.col("top60")).cast("double")).over(w)}).select(
        "day", "code", "score", *names, "contracting", "below_trend", "new_high_share")


def buffer_band(scores: DataFrame, hold: int = 5, band: int = 8) -> DataFrame:
    """Keep what is held while it ranks within the band, refill by rank (K3). ``scores``: strategy, day, code, rank.

    Each day depends on the last, so a strategy is a fold; only ranks within the band enter it.
    """
    def run(f: pd.DataFrame) -> pd.DataFrame:
        held: list[str] = []
        out = []
        for day, part in f.groupby("day", sort=True):
            codes = part.sort_values(["rank", "code"])["code"].tolist()
            held = [c for c in held if c in codes]
            held += [c for c in codes if c not in held][:max(0, hold - len(held))]
            out += [(f["strategy"].iloc[0], day, c) for c in held]
        return pd.DataFrame(out, columns=["strategy", "day", "code"])

    return fold(scores.where(F.col("rank") <= band).select("strategy", "day", "code", "rank"), ["strategy"], ["day", "rank", "code"], run, "strategy string, day date, code string")


def first_board_pullback(bars: DataFrame, limit: float = 0.1) -> DataFrame:
    """A sealed limit day after an unsealed one, then a quiet pullback within three bars, scored in four parts."""
    s = Series(bars)
    s.let(pc=s.ref("close"), v5=s.ma("volume", 5), drop20=F.col("close") / s.ref("close", 20) - 1, ma5=s.ma("close", 5), ma20=s.ma("close", 20))
    up = F.round(F.col("pc") * (1 + limit), 2)
    s.let(sealed=(F.col("close") >= up - 0.002 * F.col("pc")) & (F.col("high") > F.col("low")))
    s.let(first=F.col("sealed") & ~F.coalesce(s.ref("sealed"), F.lit(False)))
    s.let(board=F.last(F.when(F.col("first"), F.struct("_i", "close", "volume", "drop20")), ignorenulls=True).over(s.w.rowsBetween(-3, -1)))
    df = s.df.where(F.col("board").isNotNull())
    change = F.col("close") / F.col("board.close") - 1
    place = (F.col("close") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low"))
    quiet, down = F.col("volume") < 0.3 * F.col("v5"), F.col("board.drop20") < -0.1
    parts = [change.between(-0.03, 0.03), F.coalesce(place <= 0.3, F.lit(False)), F.coalesce(quiet, F.lit(False)), F.coalesce(down, F.lit(False)) & ~F.coalesce(F.col("ma5") > F.col("ma20"), F.lit(False))]
    return df.select("day", "code", (F.col("_i") - F.col("board._i")).alias("bars_since"), change.alias("change"), sum((p.cast("int") for p in parts[1:]), parts[0].cast("int")).alias("score"))


def sentiment_phase(bars: DataFrame, limit: float = 0.1) -> DataFrame:
    """Limit-up count, its 3-day mean, the share of broken boards, and the market's phase."""
    w = Window.partitionBy("code").orderBy("day")
    rows = bars.withColumn("pc", F.lag("close").over(w))
    touched, sealed = F.col("high") >= F.col("pc") * (1 + limit) * 0.998, F.col("close") >= F.col("pc") * (1 + limit) * 0.998
    day = rows.groupBy("day").agg(F.count_if(sealed).alias("boards"), F.count_if(touched).alias("touched"))
    d = Window.orderBy("day")  # one row a day
    day = day.withColumn("sma3", F.avg("boards").over(d.rowsBetween(-2, 0))).withColumn("before", F.lag("sma3").over(d)).withColumn("broken", 1 - F.col("boards") / F.when(F.col("touched") > 0, F.col("touched")))
    phase = (F.when(F.col("sma3") < 1, "ice").when((F.col("sma3") < F.col("before")) & (F.coalesce("broken", F.lit(0.0)) > 0.5), "decay").when(F.col("sma3") > 2 * F.col("before"), "climax")
             .when(F.col("sma3") > F.col("before"), "expand").otherwise("recover"))
    return day.select("day", "boards", "sma3", "broken", phase.alias("phase"))


def sector_heat(bars: DataFrame, sectors: DataFrame, n: int = 5) -> DataFrame:
    """Mean n-day return per sector and its percentile of the day (X10). ``sectors``: code, sector."""
    s = Series(bars)
    df = s.let(ret=F.col("close") / s.ref("close", n) - 1).df.where(F.col("ret").isNotNull()).join(sectors, "code")
    heat = df.groupBy("day", "sector").agg(F.avg("ret").alias("ret"))
    return heat.withColumn("heat", F.cume_dist().over(Window.partitionBy("day").orderBy("ret")))


def overnight_features(bars: DataFrame, universe: int = 50, amplitude: float = 0.1) -> DataFrame:
    """Smallest of the day by value, calm for four days, above the 5-bar exponential mean, in order of value (X11)."""
    e = recursive(bars, [("ema5", ["close"], lambda c: ema(c, 5))])
    s = Series(bars)
    s.let(amp=(s.hhv("high", 4) - s.llv("low", 4)) / s.llv("low", 4))
    small = ranked(s.df, universe, F.asc("amount"), F.col("code")).drop("rank")
    kept = small.join(e, ["code", "day"]).where((F.col("amp") <= amplitude) & (F.col("close") > F.col("ema5")))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy("amount", "code"))).select("day", "code", "amp", "ema5", "rank")


def bbi_rotation(bars: DataFrame, watched: Sequence[str]) -> DataFrame:
    """On days when a watched index rises, the smallest ratio of bbi to close, if below 1."""
    s = bbi(Series(bars))
    s.let(change=F.col("close") / s.ref("close") - 1)
    timing = s.df.where(F.col("code").isin(list(watched))).groupBy("day").agg(F.max("change").alias("best")).where("best > 0").select("day")
    df = s.df.where(~F.col("code").isin(list(watched)) & F.col("bbi").isNotNull()).withColumn("ratio", F.col("bbi") / F.col("close")).join(timing, "day", "left_semi")
    return ranked(df, 1, F.asc("ratio"), F.col("code")).where("ratio < 1").select("day", "code", "ratio")


def event_selection(events: DataFrame, bars: DataFrame, status: DataFrame, industries: DataFrame, ratings: Sequence[str], least_age: int = 365, per_industry: int = 2, total: int = 3) -> DataFrame:
    """Events effective on a day, in order, at most two an industry and three a day.

    ``events``: day, code, rating, seq. ``status``: day, code, st, list_date. A bar must exist and not open at the limit.
    """
    w = Window.partitionBy("code").orderBy("day")
    open_ok = bars.withColumn("pc", F.lag("close").over(w)).where(F.col("pc").isNotNull() & (F.col("open") < F.col("pc") * 1.098)).select("day", "code")
    df = events.where(F.col("rating").isin(list(ratings))).join(status, ["day", "code"]).where(~F.col("st") & (F.datediff("day", "list_date") >= least_age))
    df = df.join(open_ok, ["day", "code"]).join(industries, "code")
    few = ranked(df, per_industry, F.col("seq"), F.col("code"), by=["day", "industry"]).drop("rank")
    return ranked(few, total, F.col("seq"), F.col("code")).select("day", "code", "industry", "rank")
