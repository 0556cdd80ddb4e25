"""Where queries and their SQL are registered, and helpers to write the SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BY_CODE = "PARTITION BY code ORDER BY day"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def stages(base: str, steps: Sequence[dict[str, str]], select: str, tail: str = "") -> str:
    """SQL that adds columns step by step, each step seeing those before it."""
    ctes, last = [f"t0 AS ({base})"], "t0"
    for k, step in enumerate(steps, 1):
        columns = ", ".join(f"{expr} AS {name}" for name, expr in step.items())
        ctes.append(f"t{k} AS (SELECT *, {columns} FROM {last})")
        last = f"t{k}"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {select} FROM {last} {tail}"


def over(f: str, frame: str = "", by: str = BY_CODE) -> str:
    return f"{f} OVER ({by} {frame})"


def rolled(f: str, x: str, n: int) -> str:
    """An aggregate over the last n rows, null until there are n values."""
    frame = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"CASE WHEN {over(f'count({x})', frame)} = {n} THEN {over(f'{f}({x})', frame)} END"


def lag(x: str, n: int = 1) -> str:
    return over(f"lag({x}, {n})")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def round_sql(digits: int, *columns: str) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
