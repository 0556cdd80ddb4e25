"""Kernels that the other operators are built from.

All are partitioned by the key only: an as-of or range match is one union and
one window, never a join on inequalities.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spare(columns: Sequence[str], *names: str) -> list[str]:
    """Names like ``names`` that are not among ``columns`` (case aside)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def _keyed(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null among ``columns``: null keys and times match nothing."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], direction: str = "backward",
         allow_exact: bool = True, tolerance: Column | int | None = None, matched_time: str | None = None,
         bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """LEFT as-of join: for each left row the last (or, forward, the first) right row in time.

    ``right`` should have one row per key and time; of several the one with the
    greatest ``columns`` counts. ``tolerance``: largest distance in days for
    dates, seconds for timestamps, units for numbers. Unmatched rows get nulls,
    and a matched row's nulls stay nulls. Null keys and times match nothing.

    ``bucket``: a function of the time that never decreases, such as
    ``F.to_date``. A key's rows are then sorted bucket by bucket in tasks of
    their own, and only the last match of each bucket is carried on: for keys
    with more rows than a task should hold.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward or forward")
    t, m, side, r, part, carried = spare([*left.columns, *right.columns], "_t", "_m", "_side", "_r", "_part", "_carried")
    best = _keyed(right, *by, right_time).groupBy(*by, F.col(right_time).alias(t)).agg(F.max(F.struct(*columns)).alias(m))
    tagged = best.select(*by, t, F.lit(0 if allow_exact else 2).alias(side), F.struct(F.col(t).alias("t"), F.col(m).alias("m")).alias(r))
    own = left.select("*", F.col(left_time).alias(t), F.lit(1).alias(side))
    back = direction == "backward"
    both = own.unionByName(tagged, allowMissingColumns=True)
    keys = list(by)
    if bucket is not None:
        both, keys = both.withColumn(part, bucket(F.col(t))), [*by, part]
    w = Window.partitionBy(*keys).orderBy(F.col(t).asc_nulls_first() if back else F.col(t).desc_nulls_first(), F.col(side)).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(r, F.last(r, ignorenulls=True).over(w))
    if bucket is not None:
        pick = F.max_by if back else F.min_by
        ends = both.groupBy(*keys).agg(pick(r, F.when(F.col(r).isNotNull(), F.col(t))).alias(carried))
        order = Window.partitionBy(*by).orderBy(F.col(part).asc_nulls_first() if back else F.col(part).desc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn(carried, F.last(carried, ignorenulls=True).over(order))
        key = F.struct(*keys)
        met = ends.select(key.alias(m), carried)
        out = out.join(met, key.eqNullSafe(F.col(m)), "left").withColumn(r, F.coalesce(r, carried)).drop(m, carried, part)
    out = out.where(F.col(side) == 1)
    hit = F.when(F.col(t).isNotNull(), F.col(r))
    if tolerance is not None:
        kind = dict(left.dtypes)[left_time]
        gap = F.abs(F.datediff(F.col(t), F.col(f"{r}.t"))) if kind == "date" else F.abs(F.col(t).cast("double") - F.col(f"{r}.t").cast("double"))
        if kind == "timestamp_ntz":
            gap = F.abs(F.timestamp_diff("SECOND", F.col(t), F.col(f"{r}.t")))
        hit = F.when(gap <= tolerance, hit)
    out = out.withColumn(r, hit)
    names = [F.col(f"{r}.m.{c}").alias(c) for c in columns] + ([F.col(f"{r}.t").alias(matched_time)] if matched_time else [])
    return out.select(*left.columns, *names)


def range_agg(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, preceding: int, following: int, **aggregates: Callable[[Column], Column] | tuple) -> DataFrame:
    """Aggregates of the right rows whose time lies within [t - preceding, t + following] of each left row.

    Times are numbers, or dates counted in days. Each keyword is an output
    column and a pair (right column, aggregate function). Null keys and times
    match nothing; their rows have the aggregates of no rows.
    """
    def number(c: str, df: DataFrame) -> Column:
        return F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long") if dict(df.dtypes)[c] == "date" else F.col(c).cast("long")

    t, v, mine = spare([*left.columns, *right.columns], "_t", "_v", "_own")
    used = sorted({column for column, _ in aggregates.values()})
    tagged = _keyed(right, *by, right_time).select(*by, number(right_time, right).alias(t), F.struct(*used).alias(v))
    own = left.select("*", number(left_time, left).alias(t), F.lit(True).alias(mine))
    w = Window.partitionBy(*by).orderBy(t).rangeBetween(-preceding, following)
    both = own.unionByName(tagged, allowMissingColumns=True)
    values = [f(F.col(f"{v}.{column}")).over(w).alias(name) for name, (column, f) in aggregates.items()]
    return both.select("*", *values).where(mine).select(*left.columns, *aggregates)


def lookup(df: DataFrame, dimension: DataFrame, on: Sequence[str], columns: Sequence[str], most_rows: int = 100_000) -> DataFrame:
    """LEFT join of a dimension's ``columns``; one row per key, the greatest of several; null keys match nothing.

    The dimension is broadcast if it is counted at no more than ``most_rows``
    rows, else joined by shuffling.
    """
    held, r = spare([*df.columns, *dimension.columns], "_d", "_r")
    one = _keyed(dimension, *on).groupBy(*on).agg(F.max(F.struct(*columns)).alias(r))
    small = one.limit(most_rows + 1).count() <= most_rows
    kept = df.withColumn(held, F.struct(*[F.col(c).alias(f"k{k}") for k, c in enumerate(on)]))
    keyed = one.select(F.struct(*[F.col(c).alias(f"k{k}") for k, c in enumerate(on)]).alias(held), r)
    out = kept.join(F.broadcast(keyed) if small else keyed, held, "left")
    return out.select(*df.columns, *[F.col(f"{r}.{c}").alias(c) for c in columns])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The row with the greatest ``order`` of each key, in one aggregation."""
    columns = [c for c in (columns or df.columns) if c not in keys]
    (r,) = spare(df.columns, "_r")
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias(r)).select(*keys, *[f"{r}.{c}" for c in columns])


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``; the rank is pushed below the shuffle."""
    (k,) = spare(df.columns, "_n")
    return df.withColumn(k, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(k) <= n).drop(k)


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, out_col: str = "segment") -> DataFrame:
    """Number the runs of equal ``value`` (nulls equal each other) within a key, from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    changed = first | ~value.eqNullSafe(F.lag(value).over(w))
    (c,) = spare(df.columns, "_c")
    return df.withColumn(c, changed.cast("int")).withColumn(out_col, F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(c)


def fold(df: DataFrame, by: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``fn`` to each key's rows in order: for recursive formulas that windows cannot express."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return fn(frame.sort_values(list(order), kind="stable", ignore_index=True))

    return df.groupBy(*by).applyInPandas(run, schema)


def percent_rank_average(value: Column, by: Sequence[str]) -> Column:
    """Rank as a share of the non-null rows, ties sharing their mean rank; null stays null."""
    w = Window.partitionBy(*by).orderBy(value.asc_nulls_last())
    same = Window.partitionBy(*by, value)
    n = F.count(value).over(Window.partitionBy(*by))
    return F.when(value.isNotNull(), (F.rank().over(w) + (F.count(value).over(same) - 1) / 2) / n)


def percent_less(value: Column, by: Sequence[str], default: float = 0.0) -> Column:
    """(number of smaller values) / (n - 1); ``default`` for null values and lone rows."""
    w = Window.partitionBy(*by).orderBy(value.asc_nulls_last())
    n = F.count(value).over(Window.partitionBy(*by))
    return F.when(value.isNotNull() & (n > 1), (F.rank().over(w) - 1) / (n - 1)).otherwise(F.lit(default))


def winsorize(df: DataFrame, value: str, by: Sequence[str], share: float, out_col: str) -> DataFrame:
    """Clip to the order statistics k+1 from below and above, k = int(n * share)."""
    w = Window.partitionBy(*by)
    up = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    down = Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last())
    k, a, d, lo, hi = spare(df.columns, "_k", "_a", "_d", "_low", "_high")
    ranked = df.withColumn(k, F.floor(F.count(value).over(w) * share)).withColumn(a, F.row_number().over(up)).withColumn(d, F.row_number().over(down))
    low = F.max(F.when(F.col(a) == F.col(k) + 1, F.col(value))).over(w)
    high = F.max(F.when(F.col(d) == F.col(k) + 1, F.col(value))).over(w)
    clipped = F.when(F.col(value).isNotNull(), F.greatest(F.least(F.col(value), F.col(hi)), F.col(lo)))
    return ranked.withColumn(lo, low).withColumn(hi, high).withColumn(out_col, clipped).drop(k, a, d, lo, hi)
