"""Trading calendar helpers over a small table of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.kernels import asof

#: Milliseconds from UTC to the exchange's clock (UTC+8, no summer time).
ZONE_MS = 28_800_000
DAY_MS = 86_400_000


def indexed(days: DataFrame, day: str = "day") -> DataFrame:
    """Distinct days with their position from 1 and their neighbours.

    A calendar has a few thousand rows a decade, so one task orders it.
    """
    w = Window.orderBy(day)
    return days.select(day).where(F.col(day).isNotNull()).distinct().select(
        day, F.row_number().over(w).alias("pos"), F.lag(day).over(w).alias("previous"), F.lead(day).over(w).alias("next"))


def shift_days(df: DataFrame, days: DataFrame, n: int, day: str = "day", out_col: str = "shifted") -> DataFrame:
    """The n-th trading day after (before, if negative) each trading day; null outside the calendar."""
    pos = indexed(days, day).select(day, "pos")
    target = pos.select((F.col("pos") - n).alias("pos"), F.col(day).alias(out_col))
    return df.join(pos.join(target, "pos", "left").drop("pos"), day, "left")


def trading_days_between(df: DataFrame, days: DataFrame, start: str, end: str, out_col: str = "trading_days") -> DataFrame:
    """Difference of the positions of two trading days."""
    pos = indexed(days).select("day", "pos")
    a, b = pos.select(F.col("day").alias(start), F.col("pos").alias("_a")), pos.select(F.col("day").alias(end), F.col("pos").alias("_b"))
    return df.join(a, start, "left").join(b, end, "left").withColumn(out_col, F.col("_b") - F.col("_a")).drop("_a", "_b")


def first_of_period(days: DataFrame, unit: str, day: str = "day") -> DataFrame:
    """First and last trading day of each ISO week, month, quarter or year."""
    return days.groupBy(F.date_trunc(unit, day).cast("date").alias("period")).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def minute_grid(days: DataFrame, day: str = "day") -> DataFrame:
    """(day, minute of day) of the expected 1-minute bars: the 09:30 auction and two sessions, 241 a day."""
    minutes = F.concat(F.sequence(F.lit(570), F.lit(690)), F.sequence(F.lit(781), F.lit(900)))
    return days.select(day, F.explode(minutes).alias("minute"))


def session_windows(days: DataFrame, last_day, cutoff_minute: int, day: str = "day") -> DataFrame:
    """(day, start, end) of both sessions as minutes, the last day cut off."""
    both = F.array(F.struct(F.lit(571).alias("start"), F.lit(690).alias("end")), F.struct(F.lit(781).alias("start"), F.lit(900).alias("end")))
    rows = days.select(day, F.explode(both).alias("s")).select(day, "s.start", "s.end")
    cut = F.when(F.col(day) == F.lit(last_day).cast("date"), F.least(F.col("end"), F.lit(cutoff_minute))).otherwise(F.col("end"))
    return rows.where(F.col(day) <= F.lit(last_day).cast("date")).withColumn("end", cut).where("start <= end")


def local_day_number(ms: Column) -> Column:
    """Days since 1970 on the exchange's clock."""
    return F.floor((ms + ZONE_MS) / DAY_MS)


def day_start_ms(ms: Column) -> Column:
    return local_day_number(ms) * DAY_MS - ZONE_MS


def day_end_ms(ms: Column) -> Column:
    return day_start_ms(ms) + DAY_MS - 1


def next_trading_day(df: DataFrame, days: DataFrame, date: str, within: int = 14, out_col: str = "effective") -> DataFrame:
    """First trading day strictly after each date, at most ``within`` days on.

    Only the distinct dates are looked up, so however many rows share one, the
    ordered work is over the calendar.
    """
    dates = df.select(F.col(date).alias("_d")).where(F.col("_d").isNotNull()).distinct().withColumn("_k", F.lit(1))
    calendar = days.select(F.col("day").alias("_n")).distinct().select(F.lit(1).alias("_k"), "_n", F.col("_n").alias(out_col))
    found = asof(dates, calendar, ["_k"], "_d", "_n", [out_col], direction="forward", allow_exact=False, tolerance=within)
    return df.join(found.select(F.col("_d").alias(date), out_col), date, "left")
