"""Leases as a stateful processor: value and map state, event-time timers, state that is read back.

A run's lease is held by an owner until ``span`` after its last accepted beat (STR-05). The lease is the run's value state, the
number of beats of each owner under it a map state, and a timer stands at its end. When the watermark passes
that with no new beat, the timer emits the lapse and clears all state, so that a run that nobody drives takes no room. Beats
of a run in one trigger are put in order of time; a beat of another owner within the lease is fenced off.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import shared_path

SPAN = 60_000
OUT = "run long, event_id long, accepted boolean, lapsed long, owner string, beats long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Leases(StatefulProcessor):
    """Over (run, event_id, t in milliseconds, owner): a row for each beat, and one with ``lapsed`` for each lease that ended."""

    def __init__(self, span: int = SPAN):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "owner string, until long")
        self.beats = handle.getMapState("beats", "owner string", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (run,) = key
        owner, until = self.lease.get() if self.lease.exists() else (None, None)
        standing = until
        out = []
        for r in pd.concat(list(rows)).sort_values(["t", "event_id"]).itertuples():
            if owner is not None and r.t > until:
                out.append((run, None, None, until, owner, self.beats.getValue((owner,))[0]))
                self.beats.clear()
                owner = None
            accepted = owner in (None, r.owner)
            if accepted:
                owner, until = r.owner, int(r.t) + self.span
                n = self.beats.getValue((owner,))[0] if self.beats.containsKey((owner,)) else 0
                self.beats.updateValue((owner,), (n + 1,))
            out.append((run, int(r.event_id), accepted, None, r.owner, None))
        if standing is not None and standing != until:
            self.handle.deleteTimer(standing)
        self.lease.update((owner, until))
        self.handle.registerTimer(until)
        yield _frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.lease.exists():
            owner, until = self.lease.get()
            if until == expiredTimerInfo.getExpiryTimeInMs():
                out = _frame([(key[0], None, None, until, owner, self.beats.getValue((owner,))[0])])
                self.lease.clear()
                self.beats.clear()
                yield out

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["run", "event_id", "accepted", "lapsed", "owner", "beats"])
    return out.astype({"run": "int64", "event_id": "Int64", "accepted": "boolean", "lapsed": "Int64", "beats": "Int64"})


def leased(beats: DataFrame, span: int = SPAN, late: str = "10 minutes") -> DataFrame:
    """OUT of a stream of (run, event_id, t in milliseconds, owner)."""
    rows = beats.select("run", "event_id", "t", "owner", F.timestamp_millis("t").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("run").transformWithStateInPandas(Leases(span), OUT, "Append", "EventTime")


def sliced(df: DataFrame, by: str, n: int) -> DataFrame:
    """A stream of ``df`` in order of the number ``by``: ``n`` files, one for each trigger."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "slices")
    cuts = df.approxQuantile(by, [i / n for i in range(1, n)], 0.001)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = df.filter((F.lit(True) if low is None else F.col(by) > low) & (F.lit(True) if high is None else F.col(by) <= high))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@contextmanager
def rocks(spark: SparkSession):
    """Stateful processors need a store that holds several variables of a key."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def held(spark: SparkSession, at: str) -> DataFrame:
    """The leases that a drained stream's checkpoint still has: (run, owner, until)."""
    state = spark.read.format("statestore").option("stateVarName", "lease").load(f"{at}/state")
    return state.select(F.col("key.run").alias("run"), F.col("value.owner").alias("owner"), F.col("value.until").alias("until"))
