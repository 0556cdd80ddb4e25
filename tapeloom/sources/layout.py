"""One layout for two kinds of reading: a security's history and a day's cross-section.

Rows are sorted along a space-filling curve, the interleaved bits of each column's place among that column's values. A file then
holds a small rectangle of (code, day), so its statistics let a reader of one code, or of one day, pass over nearly all files; with n files
either reads about the square root of n of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.grains import count_below
from tapeloom.operators.kernels import spare

#: Bits of a column's place. A column has 2 ** BITS - 1 splitters, whatever the rows.
BITS = 8


def in_order(column: Column, kind: str) -> Column:
    """A number that never falls as the value rises; of text the first seven bytes count."""
    if kind in ("string", "binary"):
        first = F.substring(column.cast("binary"), 1, 7)
        return F.conv(F.hex(F.rpad(first, 7, F.lit(b"\x00"))), 16, 10).cast("bigint")
    if kind == "date":
        return F.unix_date(column).cast("bigint")
    if kind.startswith("timestamp"):
        return F.unix_micros(column.cast("timestamp"))
    return column.cast("double") if kind in ("double", "float") or kind.startswith("decimal") else column.cast("bigint")


def interleaved(places: Sequence[Column], bits: int = BITS) -> Column:
    """The places' bits, highest first, taken from one after another."""
    out = F.lit(0).cast("bigint")
    for bit in range(bits):
        for j, place in enumerate(places):
            own = F.shiftright(place.cast("bigint"), bit).bitwiseAND(F.lit(1).cast("bigint"))
            out = out.bitwiseOR(F.shiftleft(own, bit * len(places) + len(places) - 1 - j))
    return out


def curve(df: DataFrame, columns: Sequence[str], out: str, bits: int = BITS) -> DataFrame:
    """``df`` with its place on the curve through ``columns`` (at most 63 / ``bits`` of them); nulls are placed first.

    The splitters of a column are quantiles of it, told by one pass over ``columns`` alone; they shape the files, not the rows.
    """
    if not 0 < len(columns) * bits <= 63:
        raise ValueError("a place on the curve has at most 63 bits")
    kinds, cells = dict(df.dtypes), 1 << bits
    shares = [i / cells for i in range(1, cells)]
    numbers = [in_order(F.col(c), kinds[c]) for c in columns]
    # a fixed number of splitters each: bounded whatever the rows
    marks = df.select(*[x.alias(f"c{j}") for j, x in enumerate(numbers)]).agg(*[F.percentile_approx(f"c{j}", shares, 64 * cells).alias(f"c{j}") for j in range(len(columns))]).first()
    places = []
    for j, x in enumerate(numbers):
        splits = sorted(set(marks[j] or []))
        kind = "double" if splits and isinstance(splits[0], float) else "bigint"
        known = F.array(*[F.lit(v).cast(kind) for v in splits]) if splits else F.array().cast(f"array<{kind}>")
        # few distinct values: spread them over all the bits
        step = max(1, cells // (len(splits) + 1))
        places.append(F.coalesce(count_below(known, x, len(splits)) * step, F.lit(0)))
    return df.withColumn(out, interleaved(places, bits))


def write_by_curve(df: DataFrame, path: str, columns: Sequence[str] = ("code", "day"), files: int = 256, bits: int = BITS, mode: str = "errorifexists") -> None:
    """``df`` as about ``files`` Parquet files along the curve (S7); read it like any Parquet (S1: one code, S2: one day).

    Cells with more rows than a file are cut by the columns themselves, then by the hash of the row, so no file holds a large cell whole.
    """
    at, salt = spare(df.columns, "_at", "_salt")
    placed = curve(df, columns, at, bits).withColumn(salt, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    placed.repartitionByRange(files, at, *columns, salt).sortWithinPartitions(at, *columns, salt).drop(at, salt).write.mode(mode).parquet(path)
