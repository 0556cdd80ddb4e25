"""Queries of the recursive indicators, each with a recursive SQL of its own."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import factors
from tapeloom.functions import indicators as ind
from tapeloom.functions import scans
from tapeloom.plans.base import BY_CODE, ORACLE, lag, over, query, rolled
from tapeloom.sources.testmap import BARS, daily_bars

Step = dict[str, str]


def _ctes(steps: Sequence[Step]) -> str:
    """``p``: the bars numbered by ``i``, with columns added step by step."""
    out, last = [f"t0 AS (SELECT *, row_number() OVER ({BY_CODE}) AS i FROM ({BARS}))"], "t0"
    for k, step in enumerate(steps, 1):
        out.append(f"t{k} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in step.items())} FROM {last})")
        last = f"t{k}"
    return ", ".join(out) + f", p AS MATERIALIZED (SELECT * FROM {last})"


def _recursion(name: str, source: str, init: Step, steps: Sequence[Step], first: int = 1) -> str:
    """A recursive CTE over ``source``: state columns ``init`` at row ``first``, then by ``steps``, the last of which names the state.

    A step sees the row's columns, the state before it as ``o_`` columns, and the steps before.
    """
    inner = f"SELECT {source}.*, {', '.join(f'{name}.{c} AS o_{c}' for c in init)} FROM {name} JOIN {source} ON {source}.code = {name}.code AND {source}.i = {name}.i + 1"
    for step in steps:
        inner = f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in step.items())} FROM ({inner})"
    return (f"{name} AS (SELECT code, i, {', '.join(f'{x} AS {n}' for n, x in init.items())} FROM {source} WHERE i = {first} "
            f"UNION ALL SELECT code, i, {', '.join(init)} FROM ({inner}))")


def _out(columns: dict[str, str], digits: int) -> str:
    return ", ".join(f"round({x} + {_nudge(digits)!r}::DOUBLE, {digits}) + 0e0 AS {n}" for n, x in columns.items())


def _nudge(digits: int) -> float:
    """A shift far below the last digit: exact halves, which engines round differently, are no longer halves."""
    return 0.017 / 10 ** digits if digits > 3 else 0.0  # at three, the indicators round by themselves


def _mean(x: str, old: str, alpha: str) -> str:
    """One step of an exponential mean that starts at its first value."""
    return f"CASE WHEN {x} IS NULL THEN {old} WHEN {old} IS NULL THEN {x} ELSE {old} + {alpha} * ({x} - {old}) END"


def _register(name: str, specs: list | Callable[[DataFrame], DataFrame], steps: Sequence[Step], recursions: str, columns: dict[str, str], digits: int = 4,
              tail: str = "FROM p LEFT JOIN r USING (code, i)") -> None:
    """``specs``: kernels to fold with, or a function of the bars."""
    @query(name, f"WITH RECURSIVE {_ctes(steps)}{recursions} SELECT code, day, {_out(columns, digits)} {tail}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        bars = daily_bars(spark, d)
        done = specs(bars) if callable(specs) else ind.recursive(bars, specs)
        return done.select("code", "day", *[(F.round(F.col(c) + _nudge(digits), digits) + 0.0).alias(c) for c in columns])


def _scans(bars: DataFrame) -> scans.Scans:
    """A quarter of a security's bars is a bucket."""
    return scans.Scans(bars, F.trunc("day", "quarter"))


def _closes(bars: DataFrame) -> scans.Scans:
    """Without the other prices, which would be written for the deal by bucket."""
    return _scans(bars.select("code", "day", "close"))


def _simple(state: Step, alpha: Step, first: int = 1) -> str:
    """Independent exponential means of columns, by name."""
    return ", " + _recursion("r", "p", state, [{n: _mean(state[n], f"o_{n}", alpha[n]) for n in state}], first)


_holes = "CASE WHEN i % 7 = 0 THEN NULL ELSE volume / 1e3 END"


def _means(bars: DataFrame) -> DataFrame:
    x, alpha = F.col("close"), F.when(F.col("_i") % 7 != 0, F.col("volume") / 1e3)
    return _scans(ind.Series(bars).df).scan(ema12=scans.ema_step(x, 12), sma12=scans.mean_step(x, 1 / 12), dma_own=scans.mean_step(x, alpha), dma3=scans.mean_step(x, 0.3)).df


_register("t12_recursive_means", _means,
          [{"a": _holes}], ", " + _recursion("r", "p", {"e": "close", "s": "close", "own": "close", "t": "close"}, [{
              "e": "o_e + 2e0 / 13 * (close - o_e)", "s": "o_s + (close - o_s) / 12e0", "own": "coalesce(a, 1e0) * close + (1e0 - coalesce(a, 1e0)) * o_own", "t": "0.3e0 * close + 0.7e0 * o_t"}]),
          {"ema12": "e", "sma12": "s", "dma_own": "own", "dma3": "t"})

_register("t14_filter", [("filtered", ["open", "close"], lambda o, c: ind.suppress(c > o, 3))], [{"up": "close > open"}],
          ", " + _recursion("r", "p", {"kept": "CASE WHEN up THEN i END", "hit": "CASE WHEN up THEN 1e0 ELSE 0e0 END"}, [
              {"hit": "CASE WHEN up AND (o_kept IS NULL OR i > o_kept + 3) THEN 1e0 ELSE 0e0 END"}, {"kept": "CASE WHEN hit = 1 THEN i ELSE o_kept END"}]), {"filtered": "hit"})

# a security's closes as one list, so that a row looks back along it: no pairs of rows
_LISTS = ", l AS MATERIALIZED (SELECT code, list(close ORDER BY i) AS closes FROM p GROUP BY code)"


def _since(sign: str) -> str:
    """Rows right before this one that are all lower (higher), 0 if all are: where the first one that is not stands, going back."""
    return f"coalesce(list_position(list_transform(list_reverse(closes[1:i - 1]), lambda x: x {sign} close), true) - 1, 0)::DOUBLE"


_register("t20_ranges", [("top", ["close"], ind.top_range), ("low_range", ["close"], ind.low_range)], [], _LISTS,
          {"top": _since(">="), "low_range": _since("<=")}, tail="FROM p JOIN l USING (code)")

_register("t21_macd", lambda bars: scans.macd(_closes(bars)).df, [], ", " + _recursion("r", "p", {"s": "close", "l": "close", "dea": "0e0"}, [
    {"s": "o_s + 2e0 / 13 * (close - o_s)", "l": "o_l + 2e0 / 27 * (close - o_l)"}, {"dea": "o_dea + 0.2e0 * ((s - l) - o_dea)"}]),
    {"dif": "s - l", "dea": "dea", "macd": "(s - l - dea) * 2"}, 3)

def _kdj(bars: DataFrame) -> DataFrame:
    s = ind.Series(bars)
    s.let(_low=s.llv("low", 9), _high=s.hhv("high", 9))
    return scans.kdj(_scans(s.df), ind.divide(F.col("close") - F.col("_low"), F.col("_high") - F.col("_low")) * 100).df


_register("t22_kdj", _kdj, [{"hi": rolled("max", "high", 9), "lo": rolled("min", "low", 9)}, {"rsv": "(close - lo) / nullif(hi - lo, 0) * 100"}],
          ", " + _recursion("r", "p", {"k": "rsv", "d": "rsv"}, [{"k": _mean("rsv", "o_k", "(1e0 / 3)")}, {"d": _mean("k", "o_d", "(1e0 / 3)")}]), {"k": "k", "d": "d", "j": "3 * k - 2 * d"})

_register("t23_rsi", lambda bars: scans.rsi(_closes(bars), "close", 24, 6).df, [{"ch": f"close - {lag('close')}"}, {"up": "CASE WHEN ch IS NOT NULL THEN greatest(ch, 0e0) END", "ab": "abs(ch)"}],
          ", " + _recursion("r", "p", {"u24": "up", "a24": "ab", "u6": "up", "a6": "ab"}, [{f"{x}{n}": _mean(c, f"o_{x}{n}", f"(1e0 / {n})") for n in (24, 6) for x, c in (("u", "up"), ("a", "ab"))}]),
          {"rsi24": "u24 / nullif(a24, 0) * 100", "rsi6": "u6 / nullif(a6, 0) * 100"}, 3)

def _keltner(bars: DataFrame) -> DataFrame:
    s = ind.true_range(ind.Series(bars))
    s.let(_span=s.ma("_tr", 10), _typical=(F.col("high") + F.col("low") + F.col("close")) / 3)
    s = _scans(s.df).scan(ktn_mid=scans.ema_step(F.col("_typical"), 20))
    return s.let(ktn_up=F.col("ktn_mid") + 2 * F.col("_span"), ktn_low=F.col("ktn_mid") - 2 * F.col("_span")).df


_register("t28_keltner", _keltner, [{"tp": "(high + low + close) / 3", "lc": lag("close")}, {"tr": "CASE WHEN lc IS NOT NULL THEN greatest(high - low, abs(lc - high), abs(lc - low)) END"},
          {"span": rolled("avg", "tr", 10)}], _simple({"m": "tp"}, {"m": "(2e0 / 21)"}), {"ktn_up": "m + 2 * span", "ktn_mid": "m", "ktn_low": "m - 2 * span"})

def _trix(bars: DataFrame) -> DataFrame:
    # the first mean of trix is expma12
    done = scans.trix(_closes(bars), "close", 12, expma50=scans.ema_step(F.col("close"), 50)).let(expma12=F.col("_t1")).result("trix", "expma12", "expma50")
    s = ind.Series(done)
    return s.let(trma=s.ma("trix", 20)).df


_register("t29_trix_expma", _trix, [],
          ", " + _recursion("r", "p", {"a": "close", "b": "close", "c": "close", "f": "close"}, [{"a": "o_a + 2e0 / 13 * (close - o_a)", "f": "o_f + 2e0 / 51 * (close - o_f)"},
                                                                                            {"b": "o_b + 2e0 / 13 * (a - o_b)"}, {"c": "o_c + 2e0 / 13 * (b - o_c)"}])
          + f", q AS (SELECT code, i, a, f, (c - lag(c) OVER (PARTITION BY code ORDER BY i)) / lag(c) OVER (PARTITION BY code ORDER BY i) * 100 AS rate FROM r)"
          + ", s AS (SELECT *, CASE WHEN count(rate) OVER w = 20 THEN avg(rate) OVER w END AS trma FROM q WINDOW w AS (PARTITION BY code ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))",
          {"trix": "rate", "trma": "trma", "expma12": "a", "expma50": "f"}, tail="FROM p JOIN s USING (code, i)")

def _channel(bars: DataFrame) -> DataFrame:
    s = ind.Series(bars).let(_weighted=(2 * F.col("close") + F.col("high") + F.col("low")) / 4)
    s.let(_mean=s.ma("close", 20), _base=s.ma("_weighted", 5))
    s = _scans(s.df).scan(_centre=scans.mean_step(F.col("close"), F.abs(F.col("_weighted") - F.col("_mean")) / F.col("_mean")))
    return s.let(td1=F.col("_base") * 102 / 100, td2=F.col("_base") * 98 / 100, td3=F.col("_centre") * 1.07, td4=F.col("_centre") * 0.93).df


_register("t32_channel", _channel, [{"wt": "(2 * close + high + low) / 4", "m": rolled("avg", "close", 20)}, {"base": rolled("avg", "wt", 5), "a": "coalesce(abs(wt - m) / m, 1e0)"}],
          ", " + _recursion("r", "p", {"y": "close"}, [{"y": "a * close + (1e0 - a) * o_y"}]), {"td1": "base * 102 / 100", "td2": "base * 98 / 100", "td3": "1.07e0 * y", "td4": "0.93e0 * y"})

_B, _C = ind.SuperSmoother(10).weights
_register("t33_deviation_scaled", [("dsma", ["close"], lambda c: ind.deviation_scaled_mean(c, 20))], [{"ch": f"coalesce(close - {lag('close', 2)}, 0e0)"}, {"before": f"coalesce({lag('ch')}, 0e0)"}],
          ", " + _recursion("g", "p", {"f": "0e0", "f1": "0e0"}, [{"f": f"{1 - _B - _C!r}::DOUBLE * (ch + before) / 2 + {_B!r}::DOUBLE * o_f + {_C!r}::DOUBLE * o_f1", "f1": "o_f"}])
          + ", q AS MATERIALIZED (SELECT p.*, f, CASE WHEN count(f) OVER w = 20 THEN avg(f * f) OVER w END AS pw FROM p JOIN g USING (code, i) WINDOW w AS (PARTITION BY code ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"
          + ", s AS MATERIALIZED (SELECT *, coalesce(abs(f) / sqrt(nullif(pw, 0)) * 0.25e0, 1e0) AS a FROM q), " + _recursion("r", "s", {"y": "close"}, [{"y": "a * close + (1e0 - a) * o_y"}]),
          {"dsma": "y"})

_register("t34_sum_bars", [("sumbars", ["volume"], lambda v: ind.sum_bars(v, 200.0))], [{"up_to": over("sum(volume)", "ROWS UNBOUNDED PRECEDING")}],
          ", u AS (SELECT a.code, a.i, max(b.i) AS j FROM p a JOIN (SELECT code, i, up_to FROM p UNION ALL SELECT DISTINCT code, 0, 0e0 FROM p) b ON b.code = a.code AND b.i < a.i AND b.up_to <= a.up_to - 200 GROUP BY 1, 2)",
          {"sumbars": "coalesce(i - u.j, 0)::DOUBLE"}, tail="FROM p LEFT JOIN u USING (code, i)")

def _extremes(bars: DataFrame) -> DataFrame:
    return scans.variable_extremes(bars.select("code", "day", "close", "volume"), "close", "volume", "hhv_v", "llv_v")


_register("t7_variable_extreme", _extremes, [], _LISTS,
          {n: f"CASE WHEN floor(volume) BETWEEN 1 AND i THEN {f}(closes[i - CAST(floor(volume) AS BIGINT) + 1:i]) END" for n, f in (("hhv_v", "list_max"), ("llv_v", "list_min"))}, 9, tail="FROM p JOIN l USING (code)")

_TEN = "ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING"
_register("t35_sar", [("sar", ["high", "low"], ind.parabolic_sar)],
          [{"top": over("max(high)", _TEN), "bottom": over("min(low)", _TEN), "begin": f"CASE WHEN {lag('high')} > {lag('high', 2)} THEN 1 ELSE -1 END"}, {"floor0": "CASE WHEN begin > 0 THEN bottom ELSE top END"}],
          ", " + _recursion("r", "p", {"way": "begin", "pace": "0.02e0", "stop": "floor0", "turned": "CASE WHEN begin > 0 THEN low < floor0 ELSE high > floor0 END"}, [
              {"way": "CASE WHEN o_turned THEN -o_way ELSE o_way END"},
              {"pace": "CASE WHEN o_turned THEN 0.02e0 WHEN CASE WHEN way > 0 THEN high > top ELSE low < bottom END THEN least(0.2e0, o_pace + 0.02e0) ELSE o_pace END"},
              {"stop": "CASE WHEN o_turned THEN CASE WHEN way > 0 THEN bottom ELSE top END ELSE o_stop + pace * (CASE WHEN way > 0 THEN top ELSE bottom END - o_stop) END"},
              {"turned": "CASE WHEN way > 0 THEN low < stop ELSE high > stop END"}], first=11), {"sar": "stop"})

_register("t35_sar_from_start", [("sar0", ["high", "low"], ind.parabolic_sar_from_start)], [{"ph": lag("high"), "pl": lag("low")}],
          ", " + _recursion("r", "p", {"way": "1", "reach": "high", "pace": "0.02e0", "stop": "low"}, [
              {"beyond": "CASE WHEN o_way > 0 THEN high > o_reach ELSE low < o_reach END"},
              {"far": "CASE WHEN NOT beyond THEN o_reach WHEN o_way > 0 THEN high ELSE low END", "quick": "CASE WHEN beyond THEN least(0.2e0, o_pace + 0.02e0) ELSE o_pace END"},
              {"s": "o_stop + quick * (far - o_stop)"}, {"held": "CASE WHEN o_way > 0 THEN greatest(o_stop, least(s, low, pl)) ELSE least(o_stop, greatest(s, high, ph)) END"},
              {"turned": "CASE WHEN o_way > 0 THEN low < held ELSE high > held END"},
              {"way": "CASE WHEN turned THEN -o_way ELSE o_way END", "reach": "CASE WHEN NOT turned THEN far WHEN o_way > 0 THEN low ELSE high END", "pace": "CASE WHEN turned THEN 0.02e0 ELSE quick END",
               "stop": "CASE WHEN NOT turned THEN held WHEN o_way < 0 THEN least(low, pl) WHEN ph = far THEN far ELSE far + 0.02e0 * (low - far) END"}]), {"sar0": "stop"})


def _selected(name: str, tag: str) -> str:
    """A registered query's SQL as a table, so that its rows can be joined with others'."""
    return f"(SELECT * FROM ({ORACLE[name]}) AS {tag}_inner) AS {tag}"


# the same rows through SQL text and the table function
@query("f_factor_values", f"SELECT code, day, dif, dea, macd, sar, sar0 FROM {_selected('t21_macd', 'm')} JOIN {_selected('t35_sar', 's')} USING (code, day) JOIN {_selected('t35_sar_from_start', 'z')} USING (code, day)")
def factor_values(spark: SparkSession, d: str) -> DataFrame:
    factors.register_sql(spark)
    bars = daily_bars(spark, d).select("code", "day", "close", "high", "low")

    def one(name: str) -> DataFrame:
        return spark.sql(f"SELECT * FROM factor_values(TABLE({{bars}}) PARTITION BY (code) ORDER BY (day), '{name}')", bars=bars)

    joined = one("macd").join(one("sar"), ["code", "day"]).join(one("sar_from_start"), ["code", "day"])
    digits = {"dif": 3, "dea": 3, "macd": 3, "sar": 4, "sar0": 4}
    return joined.select("code", "day", *[(F.round(F.col(c) + _nudge(n), n) + 0.0).alias(c) for c, n in digits.items()])
