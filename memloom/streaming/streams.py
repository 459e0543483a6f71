"""Structured Streaming: idempotent ingest, compaction, tumbling counts, settled turns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from memloom.functions import clock
from memloom.operators import graph, ingest
from memloom.sources import state as store


def posts(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """JSON lines as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def once_each(rows: DataFrame, key: str = "exchange_id", at: str = "created_at", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; a later copy is caught by the store (``write_new``)."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def write_new(rows: DataFrame, root: str, checkpoint: str, key: str = "exchange_id", **trigger: Any) -> StreamingQuery:
    """Append batches to a Parquet table under ``root``, without keys it already holds.

    A batch that runs again after a failure writes the same folder again, so each row
    is stored once.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, folder = store._fs(spark, root)
        fresh = batch
        others = [s.getPath().toString() for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName() != f"batch={number}" and s.getPath().getName().startswith("batch=")] if fs.exists(folder) else []
        if others:
            fresh = batch.join(spark.read.parquet(*others).select(key), key, "left_anti")
        ingest.first_of_exchange(fresh).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def compaction(log: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Each batch of the traversal log becomes a batch of compacted edges, handed to ``merge`` with its number."""
    return log.writeStream.foreachBatch(lambda batch, number: merge(graph.compact(batch), number)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def hourly(rows: DataFrame, at: str = "ts", late: str = "2 hours") -> DataFrame:
    """(hour, event_type, n, value): tumbling hours in event time; what comes later than ``late`` is dropped."""
    timed = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(clock.hour_label(F.col("w.start")).alias("hour"), "event_type", "n", "value")


def sessions(rows: DataFrame, at: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, n): runs of events with no pause longer than ``gap``."""
    timed = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy("user_id", F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


class Settle(StatefulProcessor):
    """Emits the last text of a (conversation, turn) once it has not changed for ``seconds`` of event time, and once only."""

    def __init__(self, seconds: int = 5) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.text = handle.getValueState("text", "role string, text string, done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("ts").iloc[-1]
        if not (self.text.exists() and self.text.get()[2]):
            self.text.update((last["role"], last["text"], False))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(pd.Timestamp(last["ts"]).timestamp() * 1000) + self.seconds * 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        role, text, _ = self.text.get()
        self.text.update((role, text, True))
        words = pd.DataFrame({"role": [role], "text": [text]}, dtype=object)
        yield pd.DataFrame({"conv_id": [key[0]], "turn": [key[1]]}).join(words)

    def close(self) -> None:
        pass


def settled_turns(rows: DataFrame, seconds: int = 5, late: str = "1 minute") -> DataFrame:
    """(conv_id, turn, role, text): turns that stayed the same for ``seconds``."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("conv_id", "turn").transformWithStateInPandas(Settle(seconds), outputStructType="conv_id long, turn long, role string, text string", outputMode="append", timeMode="eventTime")


def unread_by_project(rows: DataFrame, checkpoint: str, read: Callable[[DataFrame, int], None], **trigger: Any) -> StreamingQuery:
    """The watermark of reading as a checkpoint: each batch of new rows is handed over once, again after a failure."""
    return rows.writeStream.foreachBatch(read).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
