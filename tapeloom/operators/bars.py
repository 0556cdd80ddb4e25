"""Reading bars: ranges, snapshots, last-n, adjusted prices, routing between tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.kernels import last_n

PRICES = ("open", "high", "low", "close")


def bars_in_range(bars: DataFrame, start, end, codes: Sequence[str] | None = None, day: str = "day", adjusted: str | None = None) -> DataFrame:
    """Bars of a closed range of days (S1); ``adjusted`` ("front" or "back") puts adjusted prices over the raw ones."""
    out = bars.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if codes is not None:
        out = out.where(F.col("code").isin(list(codes)))
    return with_adjusted_prices(out, adjusted) if adjusted else out


def with_adjusted_prices(bars: DataFrame, kind: str, prices: Sequence[str] = PRICES) -> DataFrame:
    """Adjusted prices for codes that have any; codes without keep the raw ones (P10)."""
    w = Window.partitionBy("code")
    has = reduce(lambda a, b: a | b, [F.max(F.col(f"{p}_{kind}").isNotNull()).over(w) for p in prices])
    return bars.withColumn("_has", has).withColumns({p: F.when(F.col("_has"), F.col(f"{p}_{kind}")).otherwise(F.col(p)) for p in prices}).drop("_has")


def snapshot(tables: Sequence[DataFrame], day, time: str = "day") -> DataFrame:
    """Cross-section of one day over several bar tables, missing columns null, latest row per code."""
    return snapshots([t.where(F.to_date(time) == F.lit(day).cast("date")) for t in tables], time)


def snapshots(tables: Sequence[DataFrame], time: str = "day") -> DataFrame:
    """The same for every day: latest row per (day, code) over the union of the tables."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    value = [c for c in rows.columns if c not in ("code", time)]
    best = rows.withColumn("trade_date", F.to_date(time)).groupBy("trade_date", "code").agg(F.max_by(F.struct(time, *value), time).alias("r"))
    return best.select("trade_date", "code", "r.*")


def last_bars(bars: DataFrame, n: int, cutoff=None, day: str = "day") -> DataFrame:
    """Newest ``n`` bars per code up to ``cutoff``, with the index -1 (newest) to -n."""
    rows = bars if cutoff is None else bars.where(F.col(day) <= F.lit(cutoff).cast("date"))
    w = Window.partitionBy("code").orderBy(F.col(day).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).withColumn("idx", -F.col("_n")).drop("_n")


def index_bars(bars: DataFrame, code: str, n: int, before, include_today: bool = False, day: str = "day") -> DataFrame:
    """Last 1 to 250 completed bars of one index."""
    if not 1 <= n <= 250:
        raise ValueError("n is 1 to 250")
    limit = F.lit(before).cast("date")
    upto = F.col(day) <= limit if include_today else F.col(day) < limit
    return last_n(bars.where((F.col("code") == code) & upto), ["code"], [F.col(day).desc()], n)


def in_sessions(ts: Column, sessions: Sequence[tuple[int, int]] = ((571, 690), (781, 900))) -> Column:
    """Whether the minute of day lies in a session, ends included; minute bars are labelled by their end."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return reduce(lambda a, b: a | b, [minute.between(a, b) for a, b in sessions])


def session_bars(bars: DataFrame, freq: str, start, cutoff, time: str = "ts", sessions: Sequence[tuple[int, int]] = ((571, 690), (781, 900))) -> DataFrame:
    """Minute bars of one native frequency within the sessions, the last day cut at ``cutoff``."""
    return bars.where((F.col("freq") == freq) & (F.col(time) >= F.lit(start).cast(dict(bars.dtypes)[time])) & (F.col(time) <= F.lit(cutoff).cast(dict(bars.dtypes)[time]))
                      & in_sessions(F.col(time), sessions))


def require_frequency(bars: DataFrame, freq: str) -> DataFrame:
    """``bars`` of ``freq``; a ``LookupError`` when there is none. One row is looked for, not counted."""
    own = bars.where(F.col("freq") == freq)
    if own.isEmpty():
        raise LookupError(f"no bars of frequency {freq}")
    return own


def trend_summary(bars: DataFrame) -> DataFrame:
    """open, volume-weighted price, volume, amount per bar; null where nothing traded."""
    return bars.select("code", "day", "open", F.when(F.col("volume") > 0, F.col("amount") / F.col("volume")).alias("vwap"), "volume", "amount")


def route_by_source(tables: Sequence[DataFrame], cutoff=None, day: str = "day") -> DataFrame:
    """Each code takes its rows from the first table that has any row up to ``cutoff``."""
    limit = F.lit(True) if cutoff is None else F.col(day) <= F.lit(cutoff).cast("date")
    ranked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.where(limit).withColumn("source_rank", F.lit(k)) for k, t in enumerate(tables)])
    return ranked.withColumn("_first", F.min("source_rank").over(Window.partitionBy("code"))).where("source_rank = _first").drop("_first")


ALIASES = {"money": "amount", "price": "close", "factor": "pctChg", "preclose": "preClose", "is_open": "volume"}


def select_fields(bars: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("code", "day")) -> DataFrame:
    """Fields by their usual names or aliases."""
    return bars.select(*keys, *[F.col(f if f in bars.columns else ALIASES.get(f, f)).alias(f) for f in fields])


def price(bars: DataFrame, codes: Sequence[str] | None = None, start=None, end=None, count: int | None = None, adjusted: str | None = None) -> DataFrame:
    """Range or count form of a bar query, long output with ``trade_date``."""
    rows = bars if codes is None else bars.where(F.col("code").isin(list(codes)))
    rows = rows if start is None else rows.where(F.col("day") >= F.lit(start).cast("date"))
    rows = rows if end is None else rows.where(F.col("day") <= F.lit(end).cast("date"))
    rows = with_adjusted_prices(rows, adjusted) if adjusted else rows
    rows = rows if count is None else last_n(rows, ["code"], [F.col("day").desc()], count)
    return rows.withColumn("trade_date", F.date_format("day", "yyyyMMdd"))
