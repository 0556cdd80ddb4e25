"""Performance of value series and trades."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.kernels import fold, islands

DAYS_A_YEAR = 250
RISK_FREE = 0.03


def daily_returns(nav: DataFrame, by: Sequence[str] = ("portfolio",), benchmark: str | None = "benchmark") -> DataFrame:
    """``r`` from the day before, the first from a start of 1; ``rb`` likewise from a start of the benchmark's first value (M1)."""
    w = Window.partitionBy(*by).orderBy("day")
    out = nav.withColumn("r", F.col("nav") / F.coalesce(F.lag("nav").over(w), F.lit(1.0)) - 1)
    return out if benchmark is None else out.withColumn("rb", F.col(benchmark) / F.coalesce(F.lag(benchmark).over(w), F.first(benchmark).over(w)) - 1)


def weekdays(start: Column, end: Column) -> Column:
    """Mondays to Fridays from start to end, both counted: arithmetic, no list of days."""
    days = F.datediff(end, start) + 1
    first = F.weekday(start)  # Monday is 0
    rest = days % 7
    weekend = F.greatest(F.lit(0), F.least(rest, first + rest - 5)) - F.greatest(F.lit(0), first + rest - 7)
    return (F.floor(days / 7) * 5 + rest - F.least(F.greatest(weekend, F.lit(0)), F.lit(2))).cast("int")


def metrics(returns: DataFrame, by: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Total and annual return, drawdown, volatility, Sharpe, Sortino, beta, alpha, information ratio, win rate (M2 to M7).

    Beta divides the sample covariance by the population variance, as is the
    custom of the platform whose figures this follows.
    """
    w = Window.partitionBy(*by)
    peak = F.max("nav").over(w.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    rows = returns.withColumn("dd", F.col("nav") / peak - 1).withColumn("m", F.avg("r").over(w)).withColumn("ex", F.col("r") - F.col("rb"))
    agg = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), (F.max_by("nav", "day") - 1).alias("total_return"), F.min("dd").alias("max_drawdown"),
                                F.sum((F.col("r") - F.col("m")) ** 2).alias("_ss"), F.sum(F.least(F.col("r"), F.lit(0.0)) ** 2).alias("_down"), F.covar_samp("r", "rb").alias("_cov"), F.var_pop("rb").alias("_varb"),
                                F.avg("ex").alias("_ex"), F.stddev_pop("ex").alias("_sdex"), F.avg((F.col("r") > F.col("rb")).cast("double")).alias("daily_win_rate"),
                                (F.max_by("benchmark", "day") / F.min_by("benchmark", "day") - 1).alias("benchmark_return"))

    def yearly(total: str) -> Column:
        return F.pow(1 + F.col(total), DAYS_A_YEAR / F.col("n")) - 1

    agg = agg.withColumns({"annual_return": yearly("total_return"), "_ab": yearly("benchmark_return"), "volatility": F.sqrt(DAYS_A_YEAR / weekdays(F.col("first_day"), F.col("last_day")) * F.col("_ss")),
                           "_dv": F.sqrt(DAYS_A_YEAR / F.col("n") * F.col("_down"))})
    agg = agg.withColumns({"sharpe": (F.col("annual_return") - RISK_FREE) / F.when(F.col("volatility") != 0, F.col("volatility")), "sortino": (F.col("annual_return") - RISK_FREE) / F.when(F.col("_dv") != 0, F.col("_dv")),
                           "beta": F.col("_cov") / F.when(F.col("_varb") != 0, F.col("_varb")), "information_ratio": F.col("_ex") / F.when(F.col("_sdex") != 0, F.col("_sdex")) * F.sqrt(F.lit(float(DAYS_A_YEAR)))})
    agg = agg.withColumn("alpha", F.col("annual_return") - (RISK_FREE + F.col("beta") * (F.col("_ab") - RISK_FREE)))
    return agg.select(*by, "n", "total_return", "annual_return", "max_drawdown", "volatility", "sharpe", "sortino", "beta", "alpha", "information_ratio", "daily_win_rate")


def trade_counts(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Win rate and profit / loss of sells (M8)."""
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    return trades.where(F.col("side") == "sell").groupBy(*by).agg(F.count("*").alias("sells"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"), (F.count_if(win) / F.count("*")).alias("win_rate"),
                                                                  (F.avg(F.when(win, F.col("pnl"))) / F.abs(F.avg(F.when(loss, F.col("pnl"))))).alias("profit_loss_ratio"))


def round_trips(trades: DataFrame, order: Sequence[str]) -> DataFrame:
    """First-in first-out pairs of buys and sells within a code (M9)."""
    w = Window.partitionBy("code", "side").orderBy(*order)
    seq = trades.withColumn("seq", F.row_number().over(w))
    buys = seq.where(F.col("side") == "buy").select("code", "seq", F.col("day").alias("buy_day"), F.col("price").alias("buy_price"))
    sells = seq.where(F.col("side") == "sell").select("code", "seq", F.col("day").alias("sell_day"), F.col("price").alias("sell_price"))
    return buys.join(sells, ["code", "seq"]).withColumn("ret", F.col("sell_price") / F.col("buy_price") - 1)


def realised_pnl(trades: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per code by moving-average cost: sells, wins, total, best and worst (M10). A running cost is a fold."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        held = cost = 0.0
        gains = []
        for side, price, volume in zip(f["side"], f["price"], f["volume"]):
            if side == "buy":
                cost = (cost * held + price * volume) / (held + volume) if held + volume else 0.0
                held += volume
            else:
                sold = min(volume, held)
                if sold > 0:
                    gains.append((price - cost) * sold)
                    held -= sold
        g = np.array(gains)
        return pd.DataFrame([{"code": f["code"].iloc[0], "sells": len(g), "wins": int((g > 0).sum()), "realised": float(g.sum()), "best": float(g.max()) if len(g) else None, "worst": float(g.min()) if len(g) else None}])

    return fold(trades.select("code", "side", "price", "volume", *order), ["code"], list(order), run, "code string, sells long, wins long, realised double, best double, worst double")


def vwap_per_day(trades: DataFrame) -> DataFrame:
    """Volume-weighted price per code and day; without volume the last price (A10)."""
    total = F.sum("volume")
    return trades.groupBy("code", "day").agg(F.when(total != 0, F.sum(F.col("price") * F.col("volume")) / total).otherwise(F.max_by("price", "id")).alias("vwap"))


def rebuild_nav(trades: DataFrame, holdings: DataFrame, capital: float) -> DataFrame:
    """NAV per day from cash flows and market values over the union of days."""
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    flow = trades.groupBy("day").agg(F.sum(sign * F.col("amount") + F.col("cost")).alias("out"))
    value = holdings.groupBy("day").agg(F.sum("market_value").alias("mv"))
    # one row a day: a single ordered task carries the running sum
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    both = flow.join(value, "day", "full").na.fill(0.0, ["out", "mv"])
    return both.withColumn("nav", (capital - F.sum("out").over(w) + F.col("mv")) / capital).select("day", "nav")


def monthly_returns(returns: DataFrame, by: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Compound return per year with one column a month."""
    monthly = returns.withColumns({"year": F.year("day"), "month": F.month("day")}).groupBy(*by, "year").pivot("month", list(range(1, 13)))
    return monthly.agg(F.product(1 + F.col("r")) - 1)


def histogram(returns: DataFrame, by: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Counts in equal-width bins, min(50, n // 2 + 1) of them."""
    w = Window.partitionBy(*by)
    low, high, n = F.min("r").over(w), F.max("r").over(w), F.count("*").over(w)
    bins = F.least(F.lit(50), F.floor(n / 2) + 1)
    rows = returns.withColumns({"_lo": low, "_hi": high, "_b": bins})
    place = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("r") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_b")), F.col("_b") - 1))
    return rows.groupBy(*by, place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def volatility_regime(returns: DataFrame, by: Sequence[str] = ("portfolio",), months: int = 60, least: int = 50, threshold: float = 0.75) -> DataFrame:
    """Monthly volatility, its rank among the last months, and reversal or momentum."""
    vol = returns.groupBy(*by, F.trunc("day", "month").alias("month")).agg((F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("vol"))
    w = Window.partitionBy(*by).orderBy("month").rowsBetween(-(months - 1), 0)
    past = F.collect_list("vol").over(w)
    share = F.size(F.filter(past, lambda x: x <= F.col("vol"))) / F.size(past)
    return vol.withColumn("share", F.when(F.size(past) >= least, share)).withColumn("regime", F.when(F.col("share") > threshold, "reversal").when(F.col("share").isNotNull(), "momentum"))


def rolling_risk(returns: DataFrame, n: int, by: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Trailing Sharpe, volatility and drawdown, null until ``n`` days are there."""
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(-(n - 1), 0)
    full = F.count("r").over(w) == n
    values = F.collect_list("nav").over(w)
    first = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(a: Column, v: Column) -> Column:
        peak = F.greatest(a["peak"], v)
        return F.struct(peak.alias("peak"), F.least(a["worst"], v / peak - 1).alias("worst"))

    sd = F.stddev_samp("r").over(w)
    return returns.withColumns({"vol": F.when(full, sd * F.sqrt(F.lit(252.0))), "sharpe": F.when(full & (sd != 0), F.avg("r").over(w) / sd * F.sqrt(F.lit(252.0))),
                                "drawdown": F.when(full, F.aggregate(values, first, step)["worst"])})


def streaks(trades: DataFrame, order: Sequence[str], by: Sequence[str] = ("code",)) -> DataFrame:
    """Longest runs of wins and of losses."""
    runs = islands(trades, by, order, F.signum("pnl"), "run").groupBy(*by, "run").agg(F.count("*").alias("n"), F.first(F.signum("pnl")).alias("s"))
    return runs.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("s") > 0, F.col("n"))), F.lit(0)).alias("max_wins"), F.coalesce(F.max(F.when(F.col("s") < 0, F.col("n"))), F.lit(0)).alias("max_losses"))


def signal_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("day", "code", "side"), threshold: float = 0.85) -> DataFrame:
    """Share of common signals among all, by distinct key."""
    both = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), list(keys), "full")
    out = both.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"))
    rate = F.col("common") / (F.col("only_a") + F.col("only_b") + F.col("common"))
    return out.withColumn("agreement", rate).withColumn("ok", rate >= threshold)


def match_rate(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("day", "code", "side", "volume")) -> DataFrame:
    """Trades equal on all keys over the larger count; repeated trades are matched one to one."""
    counts = a.groupBy(*keys).agg(F.count("*").alias("_n")).join(b.groupBy(*keys).agg(F.count("*").alias("_m")), list(keys), "full").na.fill(0, ["_n", "_m"])
    return counts.agg(F.sum(F.least("_n", "_m")).alias("matches"), F.greatest(F.sum("_n"), F.sum("_m")).alias("larger")).withColumn("rate", F.col("matches") / F.col("larger"))


def nav_deviation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Final value, drawdown and Sharpe of two series over their common days."""
    j = a.select("day", F.col("nav").alias("x")).join(b.select("day", F.col("nav").alias("y")), "day")
    w = Window.orderBy("day")  # one row a day
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumns({"rx": F.col("x") / F.lag("x").over(w) - 1, "ry": F.col("y") / F.lag("y").over(w) - 1, "dx": F.col("x") / F.max("x").over(run) - 1, "dy": F.col("y") / F.max("y").over(run) - 1})

    def sharpe(r: str) -> Column:
        return F.avg(r) / F.stddev_samp(r) * F.sqrt(F.lit(252.0))

    return j.agg((F.max_by("x", "day") / F.max_by("y", "day") - 1).alias("final_gap"), (F.min("dx") - F.min("dy")).alias("drawdown_gap"), (sharpe("rx") - sharpe("ry")).alias("sharpe_gap"), F.corr("rx", "ry").alias("correlation"))


def daily_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard overlap of held codes per day; its mean is one more aggregate away."""
    both = a.select("day", "code").distinct().withColumn("_a", F.lit(1)).join(b.select("day", "code").distinct().withColumn("_b", F.lit(1)), ["day", "code"], "full")
    return both.groupBy("day").agg((F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / F.count("*")).alias("overlap"))


def cost_gap(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("day", "code", "side")) -> DataFrame:
    """Mean absolute difference of cost over notional on matched groups."""
    def rate(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg((F.sum("cost") / F.sum("amount")).alias(name))

    return rate(a, "_a").join(rate(b, "_b"), list(keys)).agg(F.count("*").alias("groups"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mean_gap"))


def reconcile(a: DataFrame, b: DataFrame, by: Sequence[str] = ("day",)) -> DataFrame:
    """Amounts side by side with their difference."""
    x, y = a.groupBy(*by).agg(F.sum("amount").alias("left_amount")), b.groupBy(*by).agg(F.sum("amount").alias("right_amount"))
    return x.join(y, list(by), "full").na.fill(0.0).withColumn("diff", F.col("left_amount") - F.col("right_amount"))


def dividend_effect(holdings: DataFrame, actions: DataFrame, tax: float = 0.2) -> DataFrame:
    """Net cash, added shares and new cost of holdings on an ex-date."""
    j = holdings.join(actions, ["code", "day"])
    added = F.round(F.col("volume") * F.col("stock"))
    net = F.col("volume") * F.col("cash") * (1 - tax)
    return j.withColumns({"net_cash": net, "added": added, "new_cost": (F.col("cost") * F.col("volume") - net) / (F.col("volume") + added)})
