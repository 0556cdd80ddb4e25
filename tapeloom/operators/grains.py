"""Ranks, quantiles and running values of groups too large for one task.

A group's rows are cut into grains, ranges of one column that hold about ``rows`` rows each, at splitters
from a mergeable sketch of the group. Where the splitters fall changes how the work is spread, never a result. A grain is
one task's work; what the grains before it say (how many rows, their sum, their peak) is one row per grain, and goes back
to the rows by broadcast. Only groups of more than ``rows`` rows have splitters. ``rows`` is raised until there are no
more than ``MOST_GRAINS`` grains in all, which bounds what is broadcast.

``df`` is read several times (for ranks: sizes, splitters, grains, and its rows at splitters and between them); give a written table where it is dear. A table without groups is one group, whose splitters are one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.shared import pinned
from tapeloom.operators.kernels import spare

#: Rows of a grain, and the most grains of large groups in all.
ROWS, MOST_GRAINS = 20_000, 500_000


def count_below(splits: Column, value: Column, most: int) -> Column:
    """How many of the ascending ``splits``, at most ``most`` of them, are smaller than ``value``: a search by halves."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(splits, at + step - 1) < value, step).otherwise(0))


class Grains:
    """``df`` with its rows' group and grain.

    Rows whose ``column`` is null are in grain -1 of their group. Null group keys are a group. ``rows``, ``key`` and ``grain`` keep clear of
    the caller's columns.
    """

    def __init__(self, df: DataFrame, column: str, by: Sequence[str] = (), rows: int = ROWS, also: Sequence[str] = ()):
        self.column, self.columns = column, list(df.columns)
        self.key, self.grain, self.held = spare([*df.columns, *also], "_key", "_grain", "_held")
        self.df = df.withColumn(self.key, F.struct(F.lit(0).alias("all"), *by))
        sizes = self.df.where(F.col(column).isNotNull()).groupBy(self.key).agg(F.count("*").alias("n"))
        found = sizes.agg(F.sum("n").alias("rows"), F.max("n").alias("largest")).first()
        self.rows = max(rows, -(-(found["rows"] or 0) // MOST_GRAINS))
        largest = found["largest"] or 0
        self.parts = -(-largest // self.rows)
        self.large = None
        if self.parts > 1:
            self._split(sizes, dict(df.dtypes)[column])

    @classmethod
    def like(cls, other: "Grains", df: DataFrame) -> "Grains":
        """The rows of another table, without groups, placed at the splitters of ``other``."""
        own = cls.__new__(cls)
        own.column, own.columns, own.rows, own.parts = other.column, list(df.columns), other.rows, other.parts
        own.key, own.grain, own.held = spare(df.columns, "_key", "_grain", "_held")
        own.df = df.withColumn(own.key, F.struct(F.lit(0).alias("all")))
        own.large = None if other.large is None else other.large.select(F.col(other.key).alias(own.key), F.col(other.held).alias(own.held))
        return own

    def _split(self, sizes: DataFrame, kind: str) -> None:
        k, m = self.key, self.parts
        names = pinned(sizes.where(F.col("n") > self.rows).select(k))
        value = F.col(self.column)
        floating = kind in ("double", "float")
        sketched = F.when(~F.isnan(value), value) if floating else value
        of = self.df.select(k, sketched.alias("v")).join(F.broadcast(names), k, "left_semi")
        marks = of.groupBy(k).agg(F.percentile_approx("v", [i / m for i in range(1, m)], max(10_000, 8 * m)).alias("q"), F.count("*").alias("c"))
        p = F.ceil(F.col("c") / self.rows)
        some = F.transform(F.sequence(F.lit(1), F.greatest(p, F.lit(2)).cast("int") - 1), lambda i: F.get("q", F.greatest(F.floor(i * m / p).cast("int") - 1, F.lit(0))))
        splits = F.array_sort(F.array_distinct(F.filter(some, lambda x: x.isNotNull())))
        if floating:  # not a number is above all numbers, and may be many rows
            splits = F.array_append(splits, F.lit(float("nan")).cast(kind))
        # a sketch depends on the order in which parts are merged: one set of splitters for every reading
        self.large = pinned(marks.select(k, splits.alias(self.held)))

    def placed(self, singles: bool) -> DataFrame:
        """Every row with its grain: between splitters 0, 2, 4, ..., at a splitter 1, 3, 5, ... (``singles``), or up to and with it."""
        value = F.col(self.column)
        if self.large is None:
            return self.df.withColumn(self.grain, F.when(value.isNull(), -1).otherwise(0))
        both = self.df.join(F.broadcast(self.large), self.key, "left")
        splits = F.coalesce(F.col(self.held), F.array().cast(dict(self.large.dtypes)[self.held]))
        at = count_below(splits, value, self.parts + 1)
        place = at * 2 + (F.get(splits, at) == value).cast("int") if singles else at
        return both.withColumn(self.grain, F.when(value.isNull(), -1).otherwise(F.coalesce(place, at * 2))).drop(self.held)

    def of_large(self, placed: DataFrame) -> DataFrame:
        return placed.join(F.broadcast(self.large.select(self.key)), self.key, "left_semi")

    @property
    def at(self) -> list[str]:
        return [self.key, self.grain]


    def ranked(self, below: str, ties: str, n: str) -> DataFrame:
        placed = self.placed(singles=True)
        grain, x = F.col(self.grain), F.col(self.column)
        start, size, all_ = spare([*placed.columns, below, ties, n], "_start", "_size", "_all")
        nulls = placed.where(x.isNull()).select(*self.columns, *[F.lit(None).cast("long").alias(c) for c in (below, ties, n)])
        rows, single = placed.where(x.isNotNull()), None
        if self.large is None:
            rows = rows.withColumns({start: F.lit(0), all_: F.lit(None).cast("long")})
        else:
            w = Window.partitionBy(self.key)
            known = (self.of_large(rows).groupBy(*self.at).agg(F.count("*").alias(size))
                     .withColumn(start, F.sum(size).over(w.orderBy(self.grain)) - F.col(size)).withColumn(all_, F.sum(size).over(w)))
            rows = rows.join(F.broadcast(known), self.at, "left")
            at_splitter = F.coalesce(F.col(size).isNotNull() & (grain % 2 == 1), F.lit(False))
            single = rows.where(at_splitter).select(*self.columns, F.col(start).alias(below), F.col(size).alias(ties), F.col(all_).alias(n))
            rows = rows.where(~at_splitter)
        local = F.rank().over(Window.partitionBy(*self.at).orderBy(x)) - 1
        # a group without splitters is one grain
        whole = F.count("*").over(Window.partitionBy(*self.at))
        out = rows.select(*self.columns, (F.coalesce(F.col(start), F.lit(0)) + local).cast("long").alias(below), F.count("*").over(Window.partitionBy(*self.at, x)).alias(ties),
                          F.coalesce(F.col(all_), whole).alias(n)).unionByName(nulls)
        return out if single is None else out.unionByName(single)


def ranked(df: DataFrame, value: str, by: Sequence[str] = (), below: str = "below", ties: str = "ties", n: str = "n", rows: int = ROWS) -> DataFrame:
    """``df`` with, for each row, how many values of its group are smaller, how many are equal (itself included), and how many there are.

    Nulls count nowhere; for their rows all three are null. Not-a-number is above all numbers and equal to itself. A value that
    fills a grain or more is a splitter; its rows are neither moved nor sorted.
    """
    return Grains(df, value, by, rows, (below, ties, n)).ranked(below, ties, n)


def percent_rank_average(df: DataFrame, value: str, out: str, by: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """Rank as a share of the group's values, ties sharing their mean rank; null stays null."""
    b, t, n = spare([*df.columns, out], "_below", "_ties", "_n")
    return ranked(df, value, by, b, t, n, rows).withColumn(out, (F.col(b) + (F.col(t) + 1) / 2) / F.col(n)).drop(b, t, n)


def _value_at(x: str, position: Column, below: str, ties: str) -> Column:
    """The group's value that has ``position`` values before it, in order."""
    return F.max(F.when((F.col(below) <= position) & (position < F.col(below) + F.col(ties)), F.col(x)))


def quantiles(df: DataFrame, value: str, by: Sequence[str] = (), rows: int = ROWS, **shares: float) -> DataFrame:
    """Exact quantiles of each group, a column per keyword, between two values in proportion; groups without a value have none."""
    b, t, n, lo, hi, at = spare([*df.columns, *shares], "_below", "_ties", "_n", "_lo", "_hi", "_at")
    r = ranked(df, value, by, b, t, n, rows).where(F.col(value).isNotNull())
    picks = []
    for name, q in shares.items():
        at_ = (F.col(n) - 1) * F.lit(float(q))
        picks += [_value_at(value, F.floor(at_), b, t).alias(f"{lo}{name}"), _value_at(value, F.ceil(at_), b, t).alias(f"{hi}{name}"), F.max(at_ - F.floor(at_)).alias(f"{at}{name}")]
    got = r.groupBy(*by).agg(F.count("*").alias(n), *picks).where(F.col(n) > 0)
    return got.select(*by, *[(F.col(f"{lo}{k}") + (F.col(f"{hi}{k}") - F.col(f"{lo}{k}")) * F.col(f"{at}{k}")).alias(k) for k in shares])


def winsorize(df: DataFrame, value: str, out: str, share: float, by: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """Values clipped to their group's order statistics k + 1 from below and above, k = int(n * share); null stays null."""
    b, t, n, lo, hi, key, m = spare([*df.columns, out], "_below", "_ties", "_n", "_lo", "_hi", "_group", "_m")
    g = Grains(df, value, by, rows, (b, t, n, lo, hi, key, m, out))
    r = g.ranked(b, t, n).withColumn(key, F.struct(F.lit(0).alias("all"), *by))
    x, k = F.col(value), F.floor(F.col(n) * share)
    bounds = r.where(x.isNotNull()).groupBy(key).agg(F.max(n).alias(m), _value_at(value, k, b, t).alias(lo), _value_at(value, F.col(n) - 1 - k, b, t).alias(hi))
    # large groups are few, and their rows must not meet in one task; of the others no key holds more than a grain
    large = r.where(F.col(n) > g.rows).join(F.broadcast(bounds.where(F.col(m) > g.rows)), key)
    other = r.where(F.col(n) <= g.rows).join(bounds.where(F.col(m) <= g.rows), key)
    clipped = large.unionByName(other).select(*df.columns, F.greatest(F.least(x, F.col(hi)), F.col(lo)).alias(out))
    return clipped.unionByName(r.where(x.isNull()).select(*df.columns, x.alias(out)))


class LongSeries:
    """Running values of series (``by``, in order of ``order``, then ``ties``) of any length: a grain is one task's work.

    A series' grains are summed up in one row each (sum, peak, last value); the summaries, a few thousand at most for
    a thousand million rows of 20,000 a grain, are run over in order and handed to the grains. Rows without ``order`` come first. The rows of one
    instant are one grain.
    """

    def __init__(self, df: DataFrame, order: str, ties: Sequence[str] = (), by: Sequence[str] = (), rows: int = ROWS, also: Sequence[str] = ()):
        self.by, self.order = list(by), [order, *ties]
        self.g = Grains(df, order, by, rows, also)
        self.df = self.g.placed(singles=False)

    def let(self, **columns: Column) -> "LongSeries":
        self.df = self.df.withColumns(columns)
        return self

    def running(self, sums: dict[str, Column] | None = None, peaks: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> "LongSeries":
        """Columns: the sum and the greatest value up to each row, nulls left out, and the value of the row before it."""
        sums, peaks, before, g = sums or {}, peaks or {}, before or {}, self.g
        w = Window.partitionBy(*g.at).orderBy(*self.order)
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        local = {k: F.sum(x).over(run) for k, x in sums.items()} | {k: F.max(x).over(run) for k, x in peaks.items()} | {k: F.lag(x).over(w) for k, x in before.items()}
        if g.large is None:
            # nulls of the order stand in a grain of their own
            w = Window.partitionBy(g.key).orderBy(g.grain, *self.order)
            run = w.rowsBetween(Window.unboundedPreceding, 0)
            return self.let(**{k: F.sum(x).over(run) for k, x in sums.items()}, **{k: F.max(x).over(run) for k, x in peaks.items()}, **{k: F.lag(x).over(w) for k, x in before.items()})
        first, carry = spare([*self.df.columns, *local], "_first", "_carry")
        ends = {f"{carry}_{k}": F.sum(x) for k, x in sums.items()} | {f"{carry}_{k}": F.max(x) for k, x in peaks.items()}
        ends |= {f"{carry}_{k}": F.max_by(F.struct(x.alias("v")), F.struct(*self.order)) for k, x in before.items()}
        heads = self.df.groupBy(*g.at).agg(*[x.alias(k) for k, x in ends.items()])
        # every series' grains but its last say something to later ones; series of one grain are left out
        past = Window.partitionBy(g.key).orderBy(g.grain)
        upto = past.rowsBetween(Window.unboundedPreceding, -1)
        said = {f"{carry}_{k}": F.sum(f"{carry}_{k}").over(upto) for k in sums} | {f"{carry}_{k}": F.max(f"{carry}_{k}").over(upto) for k in peaks}
        said |= {f"{carry}_{k}": F.lag(f"{carry}_{k}").over(past)["v"] for k in before}
        heads = g.of_large(heads).select(*g.at, *[x.alias(k) for k, x in said.items()])
        both = self.df.withColumns({first: F.row_number().over(w) == 1, **local}).join(F.broadcast(heads), g.at, "left")
        new = {k: F.coalesce(F.col(k) + F.col(f"{carry}_{k}"), F.col(k), F.col(f"{carry}_{k}")) for k in sums}
        new |= {k: F.greatest(k, f"{carry}_{k}") for k in peaks}
        new |= {k: F.when(F.col(first), F.col(f"{carry}_{k}")).otherwise(F.col(k)) for k in before}
        self.df = both.withColumns(new).drop(first, *ends)
        return self

    def result(self, *columns: str) -> DataFrame:
        return self.df.select(*columns)


def drawdown(df: DataFrame, value: str, order: str, ties: Sequence[str] = (), by: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """Per series its worst fall from a peak (negative, 0 if none), its last value, and its mean and deviation of returns."""
    n, peak, last, fall, ret = spare([*df.columns, "n", "worst", "final", "mean_return", "deviation"], "_n", "_peak", "_last", "_fall", "_ret")
    s = LongSeries(df, order, ties, by, rows, (n, peak, last, fall, ret)).running(peaks={peak: F.col(value)}, before={last: F.col(value)})
    v = F.col(value)
    s.let(**{fall: v / F.when(F.col(peak) != 0, F.col(peak)) - 1, ret: v / F.when(F.col(last) != 0, F.col(last)) - 1})
    return s.df.groupBy(*by).agg(F.count("*").alias("n"), F.min(fall).alias("worst"), F.max_by(v, F.struct(order, *ties)).alias("final"), F.avg(ret).alias("mean_return"), F.stddev_samp(ret).alias("deviation"))
