"""Recursive series as parallel scans, in JVM expressions only.

One step of an exponential mean turns the value so far, y, into a * y + b. Such
steps compose: two in a row are one step again, whatever y is. So a series is cut
into buckets of time; a bucket's rows, in order, are folded to the one step that they make together; the
buckets' steps, one row each, are composed over the series by doubling (with the bucket 1, 2, 4, ... before);
and each bucket is folded again from the value with which it begins. A series is spread over as many tasks as it
has buckets; a task holds one bucket's rows at a time, and of a series only one row per bucket.

Before its first value a series has no y. A step therefore has a third part, the
value that it makes of nothing; null says that there is still none. A row without a value is the
step that changes nothing.

A mean of means is a step, too: its value also takes in the new values of the means that it is made of. Together they are one linear step of all
their values, so a chain of means needs one scan, not one for each.

The rows are dealt by bucket once, and stay where they are for all scans of a table; only the buckets' steps and the values with which
buckets begin are dealt again. Keep no columns in the table that are not needed: each is written for that one deal.

``variable_extremes`` are the highest and lowest of a number of rows that differs from row to row, from a
sparse table: extremes of 1, 2, 4, ... rows, two of which, overlapping, cover any number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeloom.functions.indicators import larger, smaller
from tapeloom.operators.kernels import spare


class Step(NamedTuple):
    """y becomes a * y + b, and nothing becomes ``first``."""

    a: Column
    b: Column
    first: Column


class MeanOf(NamedTuple):
    """y becomes (1 - alpha) * y + alpha * v, and nothing becomes v: the sum, by weight, of the new values ``of`` other steps."""

    of: Mapping[str, float]
    alpha: float

    def value(self, values: Mapping[str, Column]) -> Column:
        return reduce(add, [values[m] if w == 1 else values[m] * w for m, w in self.of.items()])


def mean_step(x: Column, alpha: Column | float) -> Step:
    """A step of an exponential mean: the first value seeds it, a missing value changes nothing, a missing alpha is 1."""
    a = F.coalesce(alpha, F.lit(1.0)) if isinstance(alpha, Column) else F.lit(float(alpha))
    x = x.cast("double")
    return Step(F.when(x.isNull(), 1.0).otherwise(1.0 - a), F.when(x.isNull(), 0.0).otherwise(a * x), x)


def ema_step(x: Column, n: float) -> Step:
    return mean_step(x, 2.0 / (n + 1))


def ema_of(n: float, **of: float) -> MeanOf:
    """A mean of other means of the same scan, by weight. All of them must begin at the same row, as means of one column do."""
    return MeanOf(of, 2.0 / (n + 1))


def _doublings(rows: int) -> int:
    return max(0, rows - 1).bit_length()


class _Chains:
    """Steps by name, each after those that it is a mean of, as linear maps: per name a factor for every value that it depends on, a constant ``b`` and the value made of nothing ``s``."""

    def __init__(self, steps: Mapping[str, Step | MeanOf]):
        self.steps, self.inputs = dict(steps), {}
        for n, step in steps.items():
            of = step.of if isinstance(step, MeanOf) else {}
            self.inputs[n] = list(dict.fromkeys([n, *[i for m in of for i in self.inputs[m]]]))
        self.own = {n: step for n, step in steps.items() if isinstance(step, Step)}

    def parts(self) -> list[tuple[str, str]]:
        return [(n, p) for n, inputs in self.inputs.items() for p in (*[f"f{list(self.steps).index(m)}" for m in inputs], "b", "s")]

    def factor(self, m: str) -> str:
        return f"f{list(self.steps).index(m)}"

    def nothing(self) -> Column:
        """The map that changes nothing."""
        return F.struct(*[F.struct(*[F.lit(1.0 if m == n else 0.0).alias(self.factor(m)) for m in inputs], F.lit(0.0).alias("b"), F.lit(None).cast("double").alias("s")).alias(n) for n, inputs in self.inputs.items()])

    def then(self, acc: Column, row: Column) -> Column:
        """The map ``acc``, then the step of one row."""
        new: dict[str, dict[str, Column]] = {}
        for n, step in self.steps.items():
            old, inputs = acc[n], self.inputs[n]
            if isinstance(step, Step):
                a, b, first = (row[n][p] for p in ("a", "b", "s"))
                new[n] = {self.factor(n): a * old[self.factor(n)], "b": a * old["b"] + b, "s": F.when(old["s"].isNull(), first).otherwise(a * old["s"] + b)}
                continue
            part = {}
            for p in (*[self.factor(m) for m in inputs], "b"):
                held = {m: w for m, w in step.of.items() if p in new[m]}
                part[p] = (1 - step.alpha) * old[p]
                if held:
                    part[p] = part[p] + step.alpha * MeanOf(held, step.alpha).value({m: new[m][p] for m in held})
            v = step.value({m: new[m]["s"] for m in step.of})
            new[n] = part | {"s": F.when(old["s"].isNull(), v).otherwise((1 - step.alpha) * old["s"] + step.alpha * v)}
        return F.struct(*[F.struct(*[x.alias(p) for p, x in part.items()]).alias(n) for n, part in new.items()])

    def after(self, first: Mapping[tuple[str, str], Column], second: Mapping[tuple[str, str], Column]) -> dict[tuple[str, str], Column]:
        """The map ``first``, then the map ``second``."""
        out = {}
        for n, inputs in self.inputs.items():
            for m in inputs:
                out[n, self.factor(m)] = reduce(add, [second[n, self.factor(i)] * first[i, self.factor(m)] for i in inputs if m in self.inputs[i]])
            out[n, "b"] = reduce(add, [second[n, self.factor(i)] * first[i, "b"] for i in inputs]) + second[n, "b"]
            out[n, "s"] = F.when(first[n, "s"].isNull(), second[n, "s"]).otherwise(reduce(add, [second[n, self.factor(i)] * first[i, "s"] for i in inputs]) + second[n, "b"])
        return out

    def values(self, y: Column, row: Column) -> dict[str, Column]:
        """The values after one row, from the values ``y`` before it."""
        new: dict[str, Column] = {}
        for n, step in self.steps.items():
            if isinstance(step, Step):
                new[n] = F.when(y[n].isNull(), row[n]["s"]).otherwise(row[n]["a"] * y[n] + row[n]["b"])
            else:
                v = step.value(new)
                new[n] = F.when(y[n].isNull(), v).otherwise((1 - step.alpha) * y[n] + step.alpha * v)
        return new


class Scans:
    """A table whose series (``by``, in order of ``order``, one row per value) get columns from scans.

    ``bucket`` is an expression of the row's time that never falls along a series; every value of it is a bucket, of some thousand rows at
    most (a fold copies what it has so far). Rows with equal ``order`` in a series have no defined order. Columns keep their names; those that are made
    on the way are clear of them.
    """

    def __init__(self, df: DataFrame, bucket: Column, by: Sequence[str] = ("code",), order: str = "day"):
        self.at, part = spare(df.columns, "_at", "_bucket")
        self.by, self.order = list(by), order
        cut = df.withColumn(part, bucket)
        counts = cut.select(*by, part).distinct().groupBy(*by).agg(F.count("*").alias("n"))
        self.rounds = _doublings(counts.agg(F.max("n")).first()[0] or 0)
        # structs compare as wholes, null keys and all
        key = F.struct(*[F.col(c).alias(f"k{j}") for j, c in enumerate(by)], F.col(part).alias("bucket"))
        self.df = self._named(cut.select(key.alias(self.at), *[c for c in df.columns if c not in self.by]).repartition(F.col(self.at)))

    def _named(self, df: DataFrame) -> DataFrame:
        """The keys as columns again, which the key that rows are dealt by holds."""
        return df.select(self.at, *[F.col(f"{self.at}.k{j}").alias(c) for j, c in enumerate(self.by)], *[c for c in df.columns if c != self.at])

    def _over_buckets(self, df: DataFrame) -> tuple[DataFrame, WindowSpec]:
        """One row per bucket, and the window of a series' buckets in order. Keys are columns of their own, so that windows in a row share one deal."""
        (part,) = spare(df.columns, "_bucket")
        return self._named(df).withColumn(part, F.col(f"{self.at}.bucket")), Window.partitionBy(*self.by).orderBy(part)

    def _begun(self, df: DataFrame, begin: DataFrame) -> DataFrame:
        """Every row of ``df`` with its bucket's row of ``begin``, a small table, while ``df`` stays where it is."""
        return df.join(begin.hint("shuffle_hash"), self.at)

    def let(self, **columns: Column) -> "Scans":
        self.df = self.df.withColumns(columns)
        return self

    def scan(self, before: Sequence[str] | Mapping[str, str] = (), **steps: Step | MeanOf) -> "Scans":
        """A column per step: the value after each row, or before it for those named in ``before``; if that is a mapping, it gives further columns of the values before."""
        chains, keep = _Chains(steps), [c for c in self.df.columns if c != self.at and c not in self.by]
        held = dict(before) if isinstance(before, Mapping) else {n: n for n in before}
        names = list(dict.fromkeys([*steps, *held]))
        row, rows, starts, out, heads = spare([*keep, *names, *self.by, self.at], "_row", "_rows", "_starts", "_out", "_heads")
        parts = F.struct(*[F.struct(step.a.alias("a"), step.b.alias("b"), step.first.alias("s")).alias(n) for n, step in chains.own.items()])
        packed = F.struct(F.col(self.order).alias("o"), F.struct(*keep).alias("r"), parts.alias("p"))
        grouped = self.df.groupBy(self.at).agg(F.sort_array(F.collect_list(packed)).alias(rows))

        folded = grouped.select(self.at, F.aggregate(rows, chains.nothing(), lambda acc, x: chains.then(acc, x["p"])).alias(heads))
        cells = {(n, p): f"{heads}{j}" for j, (n, p) in enumerate(chains.parts())}
        done, w = self._over_buckets(folded.select(self.at, *[F.col(heads)[n][p].alias(c) for (n, p), c in cells.items()]))
        for k in range(self.rounds):
            has, own = F.lag(F.lit(True), 1 << k).over(w), {key: F.col(c) for key, c in cells.items()}
            both = chains.after({key: F.lag(x, 1 << k).over(w) for key, x in own.items()}, own)
            done = done.withColumns({c: F.when(has, both[key]).otherwise(own[key]) for key, c in cells.items()})
        begin = done.select(self.at, F.struct(*[F.lag(cells[n, "s"]).over(w).alias(n) for n in steps]).alias(starts))
        kind = "array<struct<" + ",".join(f"`{n}`:double" for n in names) + ">>"

        def advance(acc: Column, x: Column) -> Column:
            new = F.struct(*[v.alias(n) for n, v in chains.values(acc["y"], x["p"]).items()])
            # through a list of one, so that the new values are worked out once
            return F.transform(F.array(new), lambda y: F.struct(y.alias("y"), F.concat(acc["out"], F.array(F.struct(*[(acc["y"][held[n]] if n in held else y[n]).alias(n) for n in names]))).alias("out")))[0]

        replayed = F.aggregate(rows, F.struct(F.col(starts).alias("y"), F.array().cast(kind).alias("out")), advance, lambda acc: acc["out"])
        made = self._begun(grouped, begin).select(self.at, F.explode(F.arrays_zip(F.col(rows).alias(rows), replayed.alias(out))).alias(row))
        self.df = self._named(made.select(self.at, *[F.col(f"{row}.{rows}.r.`{c}`") for c in keep if c not in names], *[F.col(f"{row}.{out}.`{n}`") for n in names]))
        return self

    def last_value(self, name: str, x: Column) -> "Scans":
        """A column of the value of ``x`` in the latest row before that has one."""
        v, starts = spare([*self.df.columns, name], "_v", "_starts")
        own = self.df.withColumn(v, x.cast("double"))
        last = own.groupBy(self.at).agg(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(self.order))).alias(starts))
        ends, w = self._over_buckets(last)
        begin = ends.select(self.at, F.last(starts, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(starts))
        w = Window.partitionBy(self.at).orderBy(self.order).rowsBetween(Window.unboundedPreceding, -1)
        self.df = self._begun(own.withColumn(v, F.last(v, ignorenulls=True).over(w)), begin).withColumn(name, F.coalesce(v, starts)).drop(v, starts)
        return self

    def result(self, *columns: str) -> DataFrame:
        return self.df.select(*self.by, self.order, *columns)


def macd(s: Scans, x: str = "close", short: int = 12, long: int = 26, m: int = 9) -> Scans:
    """dif, dea and macd, to three places."""
    s.scan(dif=ema_step(F.col(x), short), _long=ema_step(F.col(x), long), _dea=ema_of(m, dif=1, _long=-1)).let(dif=F.col("dif") - F.col("_long"))
    return s.let(macd=F.round((F.col("dif") - F.col("_dea")) * 2, 3), dea=F.round("_dea", 3)).let(dif=F.round("dif", 3))


def rsi(s: Scans, x: str = "close", *ns: int) -> Scans:
    """rsi<n> for every n, to three places: the mean rise over the mean change."""
    change = F.col(x) - F.col("_before")
    s.last_value("_before", F.col(x)).let(_up=larger(change, F.lit(0.0)), _change=F.abs(change))
    s.scan(**{f"_{c}{n}": mean_step(F.col(c), 1.0 / n) for n in ns for c in ("_up", "_change")})
    return s.let(**{f"rsi{n}": F.when(F.col(f"__change{n}") != 0, F.round(F.col(f"__up{n}") / F.col(f"__change{n}") * 100, 3)) for n in ns})


def kdj(s: Scans, rsv: Column, m1: int = 3, m2: int = 3) -> Scans:
    """k, d and j of a raw stochastic value."""
    s.scan(k=ema_step(rsv, m1 * 2 - 1), d=ema_of(m2 * 2 - 1, k=1))
    return s.let(j=F.col("k") * 3 - F.col("d") * 2)


def trix_steps(x: Column, n: int = 12) -> dict[str, Step | MeanOf]:
    """A mean of a mean of a mean."""
    return {"_t1": ema_step(x, n), "_t2": ema_of(n, _t1=1), "_t3": ema_of(n, _t2=1)}


def trix(s: Scans, x: str = "close", n: int = 12, **more: Step | MeanOf) -> Scans:
    """trix: the relative change, in per cent, of a mean of a mean of a mean; ``more`` are steps of the same scan."""
    s.scan(before={"_t4": "_t3"}, **trix_steps(F.col(x), n), **more)
    return s.let(trix=F.when(F.col("_t4") != 0, (F.col("_t3") - F.col("_t4")) / F.col("_t4") * 100))


def variable_extremes(df: DataFrame, x: str, n: str, high: str | None = None, low: str | None = None, by: Sequence[str] = ("code",), order: str = "day") -> DataFrame:
    """``high`` and ``low``: the highest and the lowest of the last ``n`` values of ``x`` in a series, ``n`` differing by row.

    Fractions of ``n`` are cut off. Null where ``n`` is null, not a number, less than one or more than the rows there are, and where one of
    the values is null. Rows are dealt by series once. For the second look-up each row is put twice in its series' order, as an entry where it stands and
    as a question where it looks, and a question takes the entry before it.
    """
    picks = {c: f for c, f in ((high, larger), (low, smaller)) if c is not None}
    i, k, at, asks, span, held, near, kept, both = spare([*df.columns, *picks], "_i", "_k", "_at", "_asks", "_span", "_held", "_near", "_kept", "_both")
    w = Window.partitionBy(*by).orderBy(order)
    whole = F.floor(F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")))
    # no look-back that counts is longer than the series, so the levels need not be either
    longest = df.groupBy(*by).agg(F.least(F.max(whole), F.count("*")).alias(span)).agg(F.max(span)).first()[0]
    rows = df.withColumn(i, F.row_number().over(w).cast("long")).withColumn(span, whole)
    rows = rows.withColumn(span, F.when((F.col(span) >= 1) & (F.col(span) <= F.col(i)), F.col(span).cast("long")))
    # floor of the logarithm from the length in bits, which no rounding touches
    rows = rows.withColumn(k, F.length(F.bin(F.col(span))) - 1).withColumn(at, F.col(i) - F.col(span) + F.expr(f"shiftleft(1L, {k})"))
    names = {c: spare(rows.columns, *[f"_{j}_level{m}" for m in range(max(1, int(longest or 1)).bit_length())]) for j, c in enumerate(picks)}
    rows = rows.withColumns({own[0]: F.col(x) for own in names.values()})
    for m in range(len(next(iter(names.values()))) - 1):
        rows = rows.withColumns({own[m + 1]: F.when(F.col(i) > 1 << m, picks[c](F.col(own[m]), F.lag(own[m], 1 << m).over(w))) for c, own in names.items()})
    levels = {c: F.array(*own) for c, own in names.items()}
    entry = F.struct(*[v.alias(f"l{j}") for j, v in enumerate(levels.values())])
    question = F.struct(*[F.col(c) for c in df.columns if c not in by], F.col(k), F.struct(*[F.get(v, F.col(k)).alias(f"l{j}") for j, v in enumerate(levels.values())]).alias(near))
    never = F.lit(False)
    twice = F.array(F.struct(F.col(i).alias(at), never.alias(asks), entry.alias(held), F.when(never, question).alias(kept)),
                    F.struct(F.col(at).alias(at), F.lit(True).alias(asks), F.when(never, entry).alias(held), question.alias(kept)))
    ordered = Window.partitionBy(*by).orderBy(F.col(at).asc_nulls_first(), asks).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.select(*by, F.explode(twice).alias(both)).select(*by, f"{both}.*").withColumn(held, F.last(held, ignorenulls=True).over(ordered)).where(asks)
    out = {c: picks[c](F.col(f"{kept}.{near}.l{j}"), F.get(F.col(f"{held}.l{j}"), F.col(f"{kept}.{k}"))) for j, c in enumerate(picks)}
    return met.select(*[F.col(c) if c in by else F.col(f"{kept}.`{c}`") for c in df.columns if c not in out], *[v.alias(c) for c, v in out.items()])


def variable_extreme(df: DataFrame, x: str, n: str, out: str, low: bool = False, by: Sequence[str] = ("code",), order: str = "day") -> DataFrame:
    """One of ``variable_extremes``."""
    return variable_extremes(df, x, n, **{"low" if low else "high": out}, by=by, order=order)
