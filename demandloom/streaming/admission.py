"""Exact sliding-window admission per key on a stream, in order of event time.

An event is admitted if fewer than ``limit`` admitted events of its key lie in the ``seconds`` before it; a rejected one takes
no place. The stream brings events in any order, so they wait in state by slots of time, and a timer at a slot's end
takes them out in order. A key is never gathered: what is in memory at once is an Arrow batch on the way in, and the
events of one key in one slot on the way out. Nothing but the last admitted times outlives its slot, and a second
timer clears those when the window has passed over them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from demandloom.streaming.requests import EVENTS, stream_folder

ADMITTED = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("admitted", T.BooleanType()),
])
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAR = np.datetime64("2262-01-01", "us")  # of the event that closes a stream; pandas ends soon after


def decide(times: Iterable[int], held: deque[int], limit: int, span: int) -> list[bool]:
    """Admission of events in order of time; ``held``: admitted times still in the window, which is kept up to date."""
    out = []
    for now in times:
        while held and held[0] < now - span:
            held.popleft()
        out.append(limit > 0 and span > 0 and len(held) < limit)
        if out[-1]:
            held.append(now)
    return out


class Admission(StatefulProcessor):
    """State of a key: waiting events by (slot, number of the chunk), chunks by slot, admitted times of the window."""

    def __init__(self, limit: int, seconds: int, slot_seconds: int) -> None:
        self.limit, self.span, self.slot = limit, seconds * 1_000_000, slot_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "slot long", "n int")
        self.waiting = handle.getMapState("waiting", "slot long, chunk int", "us array<long>, event_id array<long>")
        self.held = handle.getListState("held", "us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            chunk = chunk[chunk["event_id"].notna()]  # the closing event has none
            us = chunk["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            event, slots = chunk["event_id"].to_numpy().astype(np.int64), us // self.slot
            for slot in map(int, np.unique(slots)):
                known = self.chunks.getValue((slot,))
                n = known[0] if known else 0
                self.waiting.updateValue((slot, n), (us[slots == slot].tolist(), event[slots == slot].tolist()))
                self.chunks.updateValue((slot,), (n + 1,))
                if not n:
                    self.handle.registerTimer((slot + 1) * self.slot // 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = deque(x for (x,) in self.held.get())
        ready = sorted(slot for (slot,) in self.chunks.keys() if (slot + 1) * self.slot <= now)
        for slot in ready:
            (n,) = self.chunks.getValue((slot,))
            parts = [self.waiting.getValue((slot, k)) for k in range(n)]
            us, event = (np.concatenate([np.array(p[c], np.int64) for p in parts]) for c in (0, 1))
            order = np.lexsort((event, us))
            admitted = decide(us[order].tolist(), held, self.limit, self.span)
            for k in range(n):
                self.waiting.removeKey((slot, k))
            self.chunks.removeKey((slot,))
            yield pd.DataFrame({"user_id": key[0], "event_id": event[order], "ts": us[order].astype("datetime64[us]"), "admitted": admitted})
        edge = now // self.slot * self.slot  # what still waits or comes is no earlier
        while held and held[0] < edge - self.span:
            held.popleft()
        if not held:
            self.held.clear()
        elif ready:
            self.held.put([(x,) for x in held])
            self.handle.registerTimer(((held[-1] + self.span) // self.slot + 1) * self.slot // 1000)  # when the window has passed

    def close(self) -> None:
        pass


def admission_stream(events: DataFrame, limit: int, seconds: int, lateness: str = "1 day", slot_seconds: int | None = None) -> DataFrame:
    """user_id, event_id, ts, admitted of each event whose slot the watermark has passed.

    ``events``: as ``requests.EVENTS``. Equal times go by event_id; events without a time or an event_id are left
    out, those without a user are one key. Events later than ``lateness`` are left out by the watermark. ``slot_seconds``: width
    of a slot, by default that of the window.
    """
    rows = events.where("ts IS NOT NULL").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness)
    return rows.groupBy("user_id").transformWithStateInPandas(Admission(limit, seconds, slot_seconds or max(1, seconds)), ADMITTED, "Append", "EventTime")


def drain(spark: SparkSession, folder: str, limit: int, seconds: int, bytes_per_trigger: int = 1 << 30, lateness: str = "1 day", slot_seconds: int | None = None, files: str = "events*.parquet") -> DataFrame:
    """Admission of all events of a folder's files: two runs over one checkpoint, the second of which closes the stream.

    A trigger takes whole files up to ``bytes_per_trigger``. The first run leaves what is younger than the watermark waiting;
    the closing event, far in the future, then moves the watermark past it.
    """
    target = stream_folder(spark, "admission")
    closing = spark.createDataFrame([], EVENTS)
    closing.write.parquet(f"{target}/closing")

    def run() -> None:
        source = lambda path, glob: spark.readStream.schema(EVENTS).option("maxBytesPerTrigger", str(bytes_per_trigger)).option("pathGlobFilter", glob).parquet(path)
        stream = admission_stream(source(folder, files).unionByName(source(f"{target}/closing", "*.parquet")), limit, seconds, lateness, slot_seconds)
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{target}/_run").option("path", f"{target}/data").trigger(availableNow=True).start().awaitTermination()

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)  # the only store with several states for a key
    try:
        run()
        spark.createDataFrame([(None, pd.Timestamp(FAR).to_pydatetime(), None, None, None, None)], EVENTS).write.mode("append").parquet(f"{target}/closing")
        run()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(ADMITTED).parquet(f"{target}/data")
