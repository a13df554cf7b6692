"""The state of each document as a stream: what it is now, and which ones have stood still for too long.

One state value for each document (its newest event) and one timer: if no newer event comes within `patience` of event
time, the document is told to be stuck, unless its status is final. Events that come late take part by their own time,
so the state settles as a batch over all events has it, in whatever order they come.

What a stream tells is kept by `keep`, a batch under its number: a batch that is replayed writes the same rows in the
same place. `current` reads the newest row of each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

if TYPE_CHECKING:
    from pyspark.sql.streaming import StatefulProcessorHandle

#: Statuses after which nothing is waited for.
FINAL = ("decided", "signed")
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOLD = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("since", T.TimestampType()),
    T.StructField("seq", T.LongType()), T.StructField("stuck", T.BooleanType()),
])


class _Status(StatefulProcessor):
    """State: (microseconds, seq, status) of the newest event."""

    def __init__(self, patience: int, final: tuple[str, ...]):
        self.patience, self.final = patience, final

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long, seq long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = tuple(self.newest.get()) if self.newest.exists() else None
        best = now
        for part in rows:
            for at, seq, status in zip(part["ts"].astype("datetime64[us]").astype("int64"), part["seq"], part["status"], strict=True):
                if best is None or (int(at), int(seq)) > best[:2]:
                    best = (int(at), int(seq), status)
        if best is None or best == now:
            return
        self.newest.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if best[2] not in self.final:
            self.handle.registerTimer(best[0] // 1000 + 1000 * self.patience)
        yield self._told(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.newest.exists():
            yield self._told(key, tuple(self.newest.get()), True)

    def _told(self, key, state: tuple, stuck: bool) -> pd.DataFrame:
        since = pd.to_datetime(pd.Series([state[0]]), unit="us")
        return pd.DataFrame({"doc_id": [key[0]], "status": [state[2]], "since": since, "seq": [state[1]], "stuck": [stuck]})

    def close(self) -> None:
        pass


def statuses(events: DataFrame, patience: int = 3600, late: str = "1 hour", final: tuple[str, ...] = FINAL) -> DataFrame:
    """doc_id, status, since, seq, stuck: a row for each change of a document's state, from (doc_id, seq, status, ts timestamp).

    patience: seconds of event time after which a document without a newer event is stuck. Needs the RocksDB state store.
    """
    timed = events.select("doc_id", F.col("seq").cast("long").alias("seq"), "status", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("doc_id").transformWithStateInPandas(_Status(patience, final), TOLD, "Append", "EventTime")


def keep(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the batch's rows below the folder, under the batch's number; written again, they are the same."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return put


def current(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, status, since, stuck: the newest row of each document; of one event's rows the one that says that it is stuck."""
    rows = spark.read.parquet(folder)
    last = F.max_by(F.struct("status", "since", "stuck"), F.struct("since", "seq", "stuck"))
    return rows.groupBy("doc_id").agg(last.alias("l")).select("doc_id", "l.*")


def in_batch(events: DataFrame, until: Column, patience: int = 3600, final: tuple[str, ...] = FINAL) -> DataFrame:
    """What `current` comes to when all events are in and event time has passed `until`."""
    at = F.col("ts").cast("timestamp")
    last = events.groupBy("doc_id").agg(F.max_by(F.struct("status", at.alias("since")), F.struct(at, F.col("seq").cast("long"))).alias("l")).select("doc_id", "l.*")
    waited = F.col("since") + F.make_dt_interval(secs=F.lit(patience)) <= until
    return last.withColumn("stuck", waited & ~F.col("status").isin(*final))
