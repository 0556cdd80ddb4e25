"""Factors by name, for DataFrames and for SQL.

A factor is a kernel over one security's columns, registered under a name with the
columns that it reads and those that it gives. ``register_sql`` makes a table function
of the registry: ``factor_values(TABLE(bars) PARTITION BY (code) ORDER BY (day), 'macd')`` gives code, day
and the factor's columns. Its schema comes from the registry while the query is analysed, so an unknown
name, a missing column or a wrong parameter fails before anything runs.

A security's rows are one partition of the table function; split very long keys (ticks) by session first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tapeloom.functions import indicators as ind

Kernel = Callable[..., np.ndarray | tuple[np.ndarray, ...]]


@dataclass(frozen=True)
class Factor:
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    kernel: Kernel


FACTORS: dict[str, Factor] = {}


def factor(name: str, inputs: Sequence[str], outputs: Sequence[str], kernel: Kernel | None = None):
    """Register a kernel; without one, a decorator. Names are taken once."""
    def add(f: Kernel) -> Kernel:
        if name in FACTORS:
            raise ValueError(f"factor {name} is registered twice")
        FACTORS[name] = Factor(tuple(inputs), tuple(outputs), f)
        return f

    return add(kernel) if kernel else add


HLC = ("close", "high", "low")
factor("ema", ["close"], ["ema"], lambda c, n=12: ind.ema(c, n))
factor("sma", ["close"], ["sma"], lambda c, n=12, m=1: ind.sma(c, n, m))
factor("macd", ["close"], ["dif", "dea", "macd"], ind.macd)
factor("kdj", HLC, ["k", "d", "j"], ind.kdj)
factor("rsi", ["close"], ["rsi"], ind.rsi)
factor("trix", ["close"], ["trix", "trma"], ind.trix)
factor("keltner", HLC, ["ktn_up", "ktn_mid", "ktn_low"], ind.keltner)
factor("dsma", ["close"], ["dsma"], lambda c, n=20: ind.deviation_scaled_mean(c, n))
factor("sar", ["high", "low"], ["sar"], ind.parabolic_sar)
factor("sar_from_start", ["high", "low"], ["sar0"], ind.parabolic_sar_from_start)


def find(name: object, known: Mapping[str, Factor] = FACTORS) -> Factor:
    if name not in known:
        raise ValueError(f"unknown factor {name!r}; there are {', '.join(sorted(known))}")
    return known[name]


def factor_table(df: DataFrame, names: Sequence[str], by: Sequence[str] = ("code",), order: str = "day") -> DataFrame:
    """Key, time and the columns of the named factors, all in one pass over each security."""
    found = [find(n) for n in names]
    return ind.recursive(df, [(",".join(f.outputs), list(f.inputs), f.kernel) for f in found], by, order)


def _schema(known: Mapping[str, Factor], rows: AnalyzeArgument, name: AnalyzeArgument, numbers: Sequence[AnalyzeArgument]) -> T.StructType:
    """The schema of a call, or why it is wrong."""
    if not rows.isTable:
        raise ValueError("the first argument is a table, partitioned by its key and ordered by its time")
    if not name.isConstantExpression:
        raise ValueError("the factor's name is a constant")
    found, columns = find(name.value, known), rows.dataType.names
    missing = [c for c in found.inputs if c not in columns]
    if missing:
        raise ValueError(f"factor {name.value!r} reads {', '.join(missing)}, which the table does not have")
    for n in numbers:
        if not n.isConstantExpression or not isinstance(n.dataType, T.NumericType):
            raise ValueError("a factor's parameters are constant numbers")
    return T.StructType([*rows.dataType.fields[:2], *[T.StructField(c, T.DoubleType()) for c in found.outputs]])


class FactorValues:
    """The table function; arguments: a table partitioned by key and ordered by time, a factor's name, then numbers for its parameters in order.

    The first two columns of the table are its key and time.
    """

    known: Mapping[str, Factor] = FACTORS

    def __init__(self) -> None:
        self.keys: list[tuple] = []
        self.columns: list[list] = []
        self.kernel: Callable | None = None

    def eval(self, row, name: str, *numbers) -> None:
        if self.kernel is None:
            found = find(name, self.known)
            self.kernel, self.inputs = (lambda *x: found.kernel(*x, *(float(n) if n != int(n) else int(n) for n in numbers))), found.inputs
            self.columns = [[] for _ in self.inputs]
        self.keys.append((row[0], row[1]))
        for column, c in zip(self.columns, self.inputs):
            column.append(row[c])

    def terminate(self) -> Iterator[tuple]:
        if self.kernel is None:
            return
        result = self.kernel(*[np.array([np.nan if v is None else float(v) for v in c]) for c in self.columns])
        values = result if isinstance(result, tuple) else (result,)
        for key, *row in zip(self.keys, *[np.asarray(v, float).tolist() for v in values]):
            yield (*key, *(None if v != v else v for v in row))


def register_sql(spark: SparkSession, name: str = "factor_values") -> None:
    """Make the registry, as it stands now, a table function of the session."""
    registry = dict(FACTORS)

    class Registered(FactorValues):
        # defined here, so that it travels with its factors, the caller's own among them
        known = registry

        @staticmethod
        def analyze(rows: AnalyzeArgument, factor: AnalyzeArgument, *numbers: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(_schema(registry, rows, factor, numbers))

    spark.udtf.register(name, F.udtf(Registered))
