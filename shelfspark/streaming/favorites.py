"""The favorites toggle as a stateful stream: each user's set, in the order of addition."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class ToggleSet(StatefulProcessor):
    """State: the user's items, in order. Output: the set after each batch that touches it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getValueState("items", "items array<bigint>")

    def handleInputRows(self, key, rows, timerValues):
        current = list(self.items.get()[0]) if self.items.exists() else []
        events = pd.concat(list(rows)).sort_values("seq")
        for item in events["item"]:
            if item in current:
                current.remove(item)
            else:
                current.append(int(item))
        self.items.update((current,))
        yield pd.DataFrame({"user_id": [key[0]], "items": [current]})

    def close(self) -> None:
        pass


def toggle_stream(events: DataFrame) -> DataFrame:
    """events: a stream of user_id, item, seq. Updates of user_id, items. Needs the RocksDB state store."""
    return events.groupBy("user_id").transformWithStateInPandas(ToggleSet(), "user_id bigint, items array<bigint>", "Update", "None")


def parity_stream(events: DataFrame) -> DataFrame:
    """The active items by parity alone, for complete mode: all in the JVM, without order."""
    return events.groupBy("user_id", "item").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
