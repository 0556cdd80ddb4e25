"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a per-worker cache may hold before it starts afresh, the longest key that it keeps, and an entry's bytes beside its key.
CACHE_BYTES, CACHED_CHARS, ENTRY_BYTES = 32 << 20, 48, 180
U64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session that names none gets a temporary folder of its own;
    on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


_made: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Delete, at its end, what ``materialize`` wrote meanwhile, but for what it was told to keep; for work whose result is written by then."""
    _made.append([])
    try:
        yield
    finally:
        for df in _made.pop():
            discard(df)


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation. A
    ``scratch`` around it leaves what is to ``keep``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _made and not keep:
        _made[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a ``materialize``d frame that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], rows: str, how: str = "inner") -> DataFrame:
    """Inner (or left) join on ``key``, unique in ``right``, which tells in ``rows`` how many rows of ``left`` hold it.

    Keys of over a thousandth of those rows, of which there are fewer than a
    thousand, are broadcast; the rest is an ordinary join without hot keys.
    """
    keys = [key] if isinstance(key, str) else key
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) * 1000 > total
    few, many = right.where(hot).drop(rows), right.where(~hot).drop(rows)
    return (left.join(F.broadcast(few), keys)
            .unionByName(left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(many, keys, how)))


def crc_fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def in_fold(id_col: str, n: int, k: int) -> Column:
    return F.coalesce(crc_fold(id_col, n) == k, F.lit(False))


class WorkerCache(dict):
    """What a Python worker remembers for one operator; forgotten as soon as another operator's cache takes something in.

    Workers go from stage to stage, so caches that stayed would add up.
    """

    _all: list[WorkerCache] = []
    _owner = ""

    def __init__(self, owner: str, most: int = CACHE_BYTES):
        super().__init__()
        self.owner, self.most, self.held = owner, most, 0
        self._all.append(self)

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def shrink(self) -> None:
        """Drop the long keys, which hardly recur; all, if that does not make room."""
        for key in [k for k in self if len(k) > 7]:
            del self[key]
            self.held -= len(key) + ENTRY_BYTES
        if self.held > self.most // 2:
            self.clear()

    def remember(self, key: str, value) -> None:
        if len(key) > CACHED_CHARS:
            return
        if WorkerCache._owner != self.owner:
            WorkerCache._owner = self.owner
            for other in self._all:
                if other.owner != self.owner:
                    other.clear()
        if self.held > self.most:
            self.shrink()
        self[key] = value
        self.held += len(key) + ENTRY_BYTES


class WordHashes(WorkerCache):
    """word -> 64-bit hash, computed once per worker for words that recur."""

    def __init__(self, owner: str, seed: int):
        super().__init__(owner)
        self.seed = seed

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), self.seed)
        self.remember(word, value)
        return value


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not use yet (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
