"""Debounce by key: each key waits on its own timer and then gives its last version.

A change is (kind, key, seq, value). The first change of a (kind, key) starts a
timer of the kind's delay; when it fires, the version of the largest seq that
came meanwhile goes out (of equal seqs the larger value), and the next change
starts anew. With `reset`, each change sets the timer back. A kind without a
delay, or with one of 0, goes out at once. Keys don't wait for one another.

debounced() keeps a timer per key in Spark's state store and works by the clock.
replayed() does the same over a table whose changes carry their time: a change at
the very moment a timer fires comes after it, and a change without a time goes
out as it stands. It streams over sorted partitions and holds one version.

A null kind, key or value is a value like others; a null seq is less than any.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# fixed values: milliseconds from the first change to what follows from it
DELAYS = {"corpus": 3000, "related": 8000, "links": 3000, "engagement": 4000, "tags": 0, "scan": 900, "personal": 3000}

CHANGE = "kind string, key string, seq long, value string"
COLUMNS = ["kind", "key", "seq", "value"]
FIRED = CHANGE + ", fired timestamp"
LEAST = -(1 << 63)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """Timers need the state store that keeps its state on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def rank(seq: int | None, value: str | None) -> tuple:
    """Sorts versions: the larger is the later."""
    return (LEAST if seq is None else seq, value is not None, value or "")


class Debouncer(StatefulProcessor):
    """Holds (due, seq, value) for a key, and a timer at `due`."""

    def __init__(self, delays: Mapping[str, int], reset: bool):
        self.delays, self.reset = dict(delays), reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "due long, seq long, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind, name = key
        had = self.held.get() if self.held.exists() else None
        best = None if had is None else (had[1], had[2])
        for pdf in rows:
            for seq, value in zip(pdf["seq"].tolist(), pdf["value"].tolist()):
                own = (None if pd.isna(seq) else int(seq), value)
                if best is None or rank(*own) > rank(*best):
                    best = own
        delay = self.delays.get(kind, 0)
        if not delay:
            yield pd.DataFrame([(kind, name, *best)], columns=COLUMNS).astype({"seq": "Int64"})
            return
        if had is None or self.reset:
            due = timerValues.getCurrentProcessingTimeInMs() + delay
            if had is not None:
                self.handle.deleteTimer(had[0])
            self.handle.registerTimer(due)
        else:
            due = had[0]
        self.held.update((due, *best))
        yield pd.DataFrame(columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            _, seq, value = self.held.get()
            self.held.clear()
            yield pd.DataFrame([(*key, seq, value)], columns=COLUMNS).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, delays: Mapping[str, int] = DELAYS, reset: bool = False) -> DataFrame:
    """(kind, key, seq, value) of a stream of changes, each when its key's timer fires."""
    with_state_store(changes.sparkSession)
    keyed = changes.select(*COLUMNS).groupBy("kind", "key")
    return keyed.transformWithStateInPandas(Debouncer(delays, reset), CHANGE, "Append", "ProcessingTime")


def replayed(changes: DataFrame, delays: Mapping[str, int] = DELAYS, reset: bool = False) -> DataFrame:
    """(kind, key, seq, value, fired) over a table of changes with their time `at`; what still waits at the end fires when due."""
    known = dict(delays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, due, best = None, None, None

        def fired(out: list[list]) -> None:
            for column, value in zip(out, (*key, *best, due)):
                column.append(value)

        def batch_of(out: list[list]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.timestamp("us", "UTC"))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], [*COLUMNS, "fired"])

        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for kind, name, seq, value, at in zip(*(c.to_pylist() for c in batch.columns)):
                own, delay = (kind, name), known.get(kind, 0) * 1000
                if due is not None and (own != key or at is None or at >= due):
                    fired(out)
                    due = None
                if due is None:
                    key, best = own, (seq, value)
                    if at is None or not delay:
                        due = at
                        fired(out)
                        due = None
                    else:
                        due = at + delay
                    continue
                best = max(best, (seq, value), key=lambda v: rank(*v))
                if reset:
                    due = at + delay
            yield batch_of(out)
        if due is not None:
            out = [[] for _ in range(5)]
            fired(out)
            yield batch_of(out)

    rows = changes.select(*COLUMNS, F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    return rows.repartition("kind", "key").sortWithinPartitions("kind", "key", "at", "seq", "value").mapInArrow(run, FIRED)
