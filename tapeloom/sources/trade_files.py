"""Exported trade files in mixed encodings, as a data source.

``spark.read.format("trade_files").schema(...).load(folder)`` reads every CSV file
below a folder (or glob), one partition a file, in whatever encoding of ``encodings`` (comma-separated, tried in
order) its bytes are valid. Columns are matched by the header's names; with ``rename`` (JSON, header name
to column) headers of other languages are mapped. Numbers and dates are strict: a value that is none names its
file and line. Empty fields are null, and so are columns that a file lacks.

Files are listed and opened by Spark's file systems (``binaryFile``), so a folder may be in any store.
"""

from __future__ import annotations

import csv
import datetime
import io
import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Tried in this order: an order mark is cut off, plain Unicode next, then the older Chinese code page, which takes nearly any bytes.
ENCODINGS = ("utf-8-sig", "utf-8", "gbk")
DATE_FORMATS = ("%Y-%m-%d", "%Y%m%d", "%Y/%m/%d")


def decode(data: bytes, where: str, encodings: Sequence[str] = ENCODINGS) -> str:
    """``data`` in the first encoding that it is valid in."""
    for name in encodings:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError(f"{where}: not valid in any of {', '.join(encodings)}")


def _date(text: str) -> datetime.date:
    for form in DATE_FORMATS:
        try:
            return datetime.datetime.strptime(text, form).date()
        except ValueError:
            continue
    raise ValueError(text)


def _whole(text: str) -> int:
    number = float(text.replace(",", ""))
    if number != int(number):
        raise ValueError(text)
    return int(number)


def _number(text: str) -> float:
    number = float(text.replace(",", ""))
    if number != number or number in (float("inf"), float("-inf")):
        raise ValueError(text)
    return number


def _reader(kind: T.DataType) -> Callable[[str], object]:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return _whole
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _number
    if isinstance(kind, T.DateType):
        return _date
    if isinstance(kind, T.StringType):
        return str
    raise ValueError(f"trade files hold text, whole numbers, numbers and dates, not {kind.simpleString()}")


def parse(data: bytes, where: str, schema: T.StructType, rename: Mapping[str, str], encodings: Sequence[str] = ENCODINGS) -> Iterator[tuple]:
    """The rows of one file; quoted fields may hold line ends."""
    lines = csv.reader(io.StringIO(decode(data, where, encodings), newline=""), strict=True)
    head = [rename.get(h.strip(), h.strip()) for h in next(lines, [])]
    at = [head.index(f.name) if f.name in head else None for f in schema]
    readers = [_reader(f.dataType) for f in schema]
    for row in lines:
        if not any(v.strip() for v in row):
            continue
        if len(row) != len(head):
            raise ValueError(f"{where}, line {lines.line_num}: {len(row)} fields, the header has {len(head)}")
        out = []
        for field, k, read in zip(schema, at, readers):
            text = row[k].strip() if k is not None else ""
            try:
                out.append(read(text) if text else None)
            except ValueError:
                raise ValueError(f"{where}, line {lines.line_num}: {text!r} is no {field.dataType.simpleString()} for {field.name}") from None
        yield tuple(out)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TradeFiles(DataSource):
    """Local folders only (``open``); ``read_trade_files`` does the same over any store."""

    @classmethod
    def name(cls) -> str:
        return "trade_files"

    def schema(self) -> str:
        raise ValueError("trade_files needs a schema: spark.read.format('trade_files').schema(...)")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TradeFilesReader(schema, dict(self.options))


class _TradeFilesReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.table, self.path = schema, options["path"].removeprefix("file:")
        self.rename = json.loads(options.get("rename", "{}"))
        self.encodings = [e.strip() for e in options.get("encodings", ",".join(ENCODINGS)).split(",")]
        for field in schema:
            _reader(field.dataType)

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found = [self.path] if os.path.isfile(self.path) else glob.glob(f"{self.path}/**/*.csv", recursive=True) if os.path.isdir(self.path) else glob.glob(self.path, recursive=True)
        if not found:
            raise ValueError(f"no CSV files at {self.path}")
        return [_File(p) for p in sorted(found)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from parse(f.read(), partition.path, self.table, self.rename, self.encodings)


def parse_files(files: DataFrame, schema: T.StructType, rename: Mapping[str, str] | None = None, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """The rows of files given as (path, content), as Spark's ``binaryFile`` source reads them from any store.

    A file is parsed whole by one task; files are what exports split by day and account.
    """
    names = dict(rename or {})
    for field in schema:
        _reader(field.dataType)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=schema.names, dtype=object)

        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                rows += parse(bytes(content), path, schema, names, encodings)
                if len(rows) >= 10_000:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    return files.select("path", "content").mapInPandas(read, schema)


def read_trade_files(spark: SparkSession, path: str, schema: T.StructType | str, rename: Mapping[str, str] | None = None, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """All CSV files below ``path`` as one table."""
    table = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(path)
    return parse_files(files, table, rename, encodings)
