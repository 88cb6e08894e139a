"""Toggles and debouncing by event time: rows are held back until the watermark has passed them, then applied in order.

The state's key is a group of users, by hash, so that one call of Python serves all users of a group in
numpy. Both operators keep a group's waiting rows in a list state, a packed value for each micro-batch, and have a timer at the
earliest moment at which one of them is due. When the watermark reaches it, all due
rows are taken by user, ts and seq, however they arrived. Rows that arrive after the
watermark has passed their time are late beyond what was allowed, and Spark drops
them. Rows of no user are dropped as well. Held rows of a stream that ends wait for a watermark beyond them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shelfspark.sources.staging import new_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MILLI = 1000
#: Groups of users. A group's state is read and written as a whole, so it should hold no more than some 100,000 waiting rows and items.
GROUPS = 1024
#: Rows of the packed matrices: users, times in microseconds, numbers, items.
_FIELDS = ("user_id", "ts", "seq", "item")


def _unpacked(value: bytes, fields: int) -> np.ndarray:
    return np.frombuffer(value, np.int64).reshape(fields, -1)


class _Held(StatefulProcessor):
    """Holds rows of _FIELDS until `wait` microseconds after their time are below the watermark."""

    wait = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "packed binary")

    def _expect(self, times: np.ndarray) -> None:
        """A timer for the earliest row, in whole milliseconds, not before it is due."""
        if len(times):
            self.handle.registerTimer(-(-(int(times.min()) + self.wait) // _MILLI))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        new = np.stack([arrived[c].astype("int64").to_numpy() for c in _FIELDS])
        self.held.appendValue((new.tobytes(),))
        self._expect(new[1])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * _MILLI
        rows = np.concatenate([np.empty((len(_FIELDS), 0), np.int64), *[_unpacked(r[0], len(_FIELDS)) for r in self.held.get()]], axis=1)
        due = rows[1] + self.wait <= mark
        if not due.any():
            return iter(())
        order = np.lexsort((rows[3], rows[2], rows[1], rows[0]))
        rows, due = rows[:, order], due[order]
        out = list(self.take(rows, due))
        rest = rows[:, ~due]
        if rest.shape[1]:
            self.held.put([(rest.tobytes(),)])
        else:
            self.held.clear()
        self._expect(rest[1])
        return iter(out)

    def take(self, rows: np.ndarray, due: np.ndarray) -> Iterator[pd.DataFrame]:
        """rows: by user, time, number and item; due: which of them are, the first ones of each user."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class OrderedToggles(_Held):
    """Each user's set after each release: items in the order in which they were added, and how many toggles made it.

    An item is in the set after an odd number of toggles, and its last one added it; so the state has
    the last toggles of the items that are there, and each user's count.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sets = handle.getValueState("sets", "added binary, counts binary")

    def take(self, rows, due):
        added, counts = self.sets.get() if self.sets.exists() else (b"", b"")
        both = np.concatenate([_unpacked(added, len(_FIELDS)), rows[:, due]], axis=1)
        user, ts, seq, item = both = both[:, np.lexsort((both[2], both[1], both[3], both[0]))]
        last = np.flatnonzero(np.append((user[1:] != user[:-1]) | (item[1:] != item[:-1]), True))
        odd = np.diff(last, prepend=-1) % 2 == 1
        both = both[:, last[odd]]
        user, ts, seq, item = both = both[:, np.lexsort((both[3], both[2], both[1], both[0]))]
        touched, times = np.unique(rows[0, due], return_counts=True)
        before = _unpacked(counts, 2)
        known, at = np.unique(np.concatenate([before[0], touched]), return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, at, np.concatenate([before[1], times]))
        self.sets.update((both.tobytes(), np.stack([known, total]).tobytes()))
        begin, end = np.searchsorted(user, touched, "left"), np.searchsorted(user, touched, "right")
        yield pd.DataFrame({"user_id": touched, "toggles": total[np.searchsorted(known, touched)], "items": [item[b:e].tolist() for b, e in zip(begin, end)]})


class QuietEvents(_Held):
    """The events that no other of the user follows within the quiet time. An event is decided once no such follower can arrive any more."""

    def __init__(self, quiet_ms: int):
        self.wait = quiet_ms * 1000

    def take(self, rows, due):
        user, ts = rows[0], rows[1]
        quiet = np.append((user[1:] != user[:-1]) | (ts[1:] - ts[:-1] >= self.wait), True)
        kept = due & quiet
        if kept.any():
            yield pd.DataFrame({"user_id": user[kept], "seq": rows[2, kept]})


def _by_group(events: DataFrame, delay: str, *columns):
    rows = events.withWatermark("ts", delay).filter("user_id is not null")
    group = F.pmod(F.xxhash64(F.col("user_id").cast("bigint")), F.lit(GROUPS)).alias("user_group")
    return rows.select(group, F.col("user_id").cast("bigint").alias("user_id"), F.col("ts").alias("event_time"), F.unix_micros("ts").alias("ts"), "seq", *columns).groupBy("user_group")


def ordered_toggles(events: DataFrame, delay: str) -> DataFrame:
    """events: a stream of user_id, ts (a timestamp), seq, item. Appends user_id, toggles, items; the row of most toggles is the user's newest."""
    rows = _by_group(events, delay, F.col("item").cast("bigint").alias("item"))
    return rows.transformWithStateInPandas(OrderedToggles(), "user_id bigint, toggles bigint, items array<bigint>", "Append", "EventTime")


def quiet_events(events: DataFrame, delay: str, quiet_ms: int = 250) -> DataFrame:
    """events: a stream of user_id, ts, seq. Appends user_id, seq of the events that a trailing debounce lets through."""
    rows = _by_group(events, delay, F.lit(0).cast("bigint").alias("item"))
    return rows.transformWithStateInPandas(QuietEvents(quiet_ms), "user_id bigint, seq bigint", "Append", "EventTime")


def run_to_end(stream: DataFrame, label: str) -> DataFrame:
    """All that the stream gives until its input is used up, written by a file sink (each batch once) to the shared folder."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    path = new_folder(spark, label)
    spark.conf.set(key, ROCKSDB)
    try:
        writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


#: Files of a micro-batch of replayed() at least. It has a folder's files, so that micro-batches do not grow in number with the table.
FILES = 8


def replayed(events: DataFrame, label: str, folders: int = 6, closing: bool = True) -> DataFrame:
    """A table of events (user_id, ts, seq, ..) as a stream whose rows are out of order: half of them come a folder of files later than their time. Rows are late by less than two of the `folders` equal parts of the time. A closing row, ten years later and of user 0, moves the watermark beyond all others."""
    spark = events.sparkSession
    path = new_folder(spark, label)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(FILES, events.rdd.getNumPartitions()))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        events.write.parquet(f"{path}/0")
        return stream.parquet(f"{path}/*")
    begin, span = F.unix_micros(F.lit(first)), F.greatest(F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)), F.lit(1))
    part = F.floor((F.unix_micros("ts") - begin) / span * folders).cast("int")
    batch = F.least(part + F.pmod(F.xxhash64("seq"), F.lit(2)), F.lit(folders - 1))
    for k in range(folders):
        events.filter(batch == k).write.parquet(f"{path}/{k}")
    if closing:
        row = {f.name: F.lit(0).cast(f.dataType) for f in events.schema if f.name != "ts"}
        row["ts"] = (F.lit(last) + F.expr("interval 3650 days")).cast(events.schema["ts"].dataType)
        spark.range(1).select(*[row[c].alias(c) for c in events.columns]).write.parquet(f"{path}/{folders}")
    return stream.parquet(f"{path}/*")
