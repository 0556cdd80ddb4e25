"""Factor observations with state that is kept by key and leaves again.

``observe_revisions`` is ``operators.adjust.observe`` as a stream: a row for every new or
moved value of a (code, day), numbered by revision. A key's state is its latest value and revision, and
the sequence numbers that it has seen, so that a row that comes twice counts once. State lasts for a time after
its last use, then it leaves, on request with a row that says so; a ledger may be given to start from. Needs the RocksDB state store
(``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEPT_MS = 30 * 86_400_000
OUT = "code string, day string, factor double, revision_no int, alert boolean, expired boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """The session's settings for such streams. Without batches of no data a run over what is there ends; timers then fire with the next data."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Observer(StatefulProcessor):
    """One key's observations. ``told`` says whether the end of a key's state is a row of its own (``expired``)."""

    def __init__(self, abs_tol: float, rel_tol: float, kept_ms: int, told: bool):
        self.abs_tol, self.rel_tol, self.kept_ms, self.told = abs_tol, rel_tol, kept_ms, told

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a state whose end is told waits for its timer; others leave by themselves
        ttl = None if self.told else self.kept_ms
        self.latest = handle.getValueState("latest", "factor double, revision int", ttlDurationMs=ttl)
        self.seen = handle.getMapState("seen", "seq long", "factor double", ttlDurationMs=ttl)

    def _renew(self, timers) -> None:
        if not self.told:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.kept_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        last = initialState.sort_values("revision_no").iloc[-1]
        self.latest.update((float(last["factor"]), int(last["revision_no"])))
        self._renew(timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, revision = self.latest.get() if self.latest.exists() else (None, 0)
        out = []
        for row in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            seq, factor = int(row.seq), float(row.factor)
            if self.seen.containsKey((seq,)):
                continue
            self.seen.updateValue((seq,), (factor,))
            if value is not None:
                delta = abs(factor - value)
                if not (delta > self.abs_tol and delta > self.rel_tol * abs(value)):
                    continue
            revision += 1
            out.append((key[0], key[1], factor, revision, value is not None, False))
            value = factor
        if value is not None:
            self.latest.update((value, revision))
        self._renew(timerValues)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.told and self.latest.exists():
            value, revision = self.latest.get()
            out.append((key[0], key[1], value, revision, False, True))
        self.latest.clear()
        self.seen.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def observe_revisions(stream: DataFrame, ledger: DataFrame | None = None, abs_tol: float = 1e-9, rel_tol: float = 1e-6, kept_ms: int = KEPT_MS, told: bool = False) -> DataFrame:
    """Rows to append to the ledger from a stream of (code, day, factor, seq); days are text.

    ``ledger``: code, day, factor, revision_no, the latest of each key counts; it is read at the stream's first start only.
    A change is told from the last value that was told, beyond both tolerances. Rows of a key in one batch go by ``seq``; a ``seq`` counts once
    while it is kept, which is as long. A key that is silent for ``kept_ms`` is forgotten: a later value is its first again.
    """
    start = None if ledger is None else ledger.groupBy("code", "day").agg(F.max(F.struct("revision_no", "factor")).alias("l")).select("code", "day", "l.factor", "l.revision_no").groupBy("code", "day")
    return stream.groupBy("code", "day").transformWithStateInPandas(Observer(abs_tol, rel_tol, kept_ms, told), OUT, "Append", "ProcessingTime", start)
