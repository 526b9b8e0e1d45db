"""Exponential means of a stream: windows of event time, closed by a watermark, are folded in order by a state a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.tables import new_path


def windowed_means(events: DataFrame, key: str, ts: str, value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """A stream of rows -> key, start, value: the mean of each window of each key, once no row may come for it any more.

    Rows that come later than late behind the newest one, in a window that is closed, aren't counted; the query's progress says how many these were.
    """
    timed = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    means = timed.withWatermark("ts", late).groupBy("key", F.window("ts", window).alias("w")).agg(F.avg("value").alias("value"))
    return means.select("key", "w", "value")


class Fold(StatefulProcessor):
    """A key's windows in order, folded from its last result on."""

    def __init__(self, keep: float):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        last = self.last.get()[0] if self.last.exists() else None
        windows = pd.concat(list(rows)).sort_values("start")
        found = []
        for value in windows.value:
            if pd.notna(value):
                last = value if last is None else self.keep * last + (1 - self.keep) * value
            found.append(last)
        if last is not None:
            self.last.update((float(last),))
        yield pd.DataFrame({"key": [key[0]] * len(windows), "start": windows.start.to_numpy(), "value": windows.value.to_numpy(), "ema": np.array(found, dtype=float)})

    def close(self) -> None:
        pass


def exponential_means(means: DataFrame, keep: float = 0.9) -> DataFrame:
    """windowed_means() -> key, start, value, ema: each key's windows in order, the first one's mean as it is; keep of the last result and the rest of the new mean.

    A key's state is its last result. The windows of a key that close together come to it together and are folded in order; those that close later begin later. A window without a mean
    passes the last result on. Rows are summed before they come here, so that a key of any number of rows is a row a window.
    """
    closed = means.select("key", F.col("w.start").alias("start"), "value")
    return closed.groupBy("key").transformWithStateInPandas(Fold(keep), "key string, start timestamp, value double, ema double", "Append", "None")


#: The store that holds states of more than one value.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_to_end(found: DataFrame) -> tuple[DataFrame, StreamingQuery]:
    """All that is there now goes through the stream; its rows as a table in the shared folder, and the query. Progress and state are there too, so that a run that breaks off goes on where it was."""
    spark = found.sparkSession
    table, state = new_path(spark, "streams"), new_path(spark, "progress")
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(table)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(table), query


def dropped_rows(query: StreamingQuery) -> int:
    """How many rows came too late, over all recent batches of a query."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
