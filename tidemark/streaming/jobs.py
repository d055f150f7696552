"""Append, tail and materialise as streams.

Each job takes a stream of records and runs with any trigger; tests and queries use availableNow, which reads
what there is and ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..session import prepared
from ..sources.tables import LogTable


class LastSeq(StatefulProcessor):
    """Keeps each writer's highest append_seq and lets through what is above it, in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_seq", "last_seq bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else -1
        batch = pd.concat(list(rows)).sort_values("append_seq", kind="stable")
        fresh = batch[batch["append_seq"] > last].drop_duplicates("append_seq")
        if len(fresh):
            self.last.update((int(fresh["append_seq"].max()),))
        yield fresh

    def close(self) -> None:
        pass


def deduplicated(stream: DataFrame) -> DataFrame:
    """A stream of (writer_id, append_seq, ...) without repetitions: idempotent append.

    State is one number a writer.
    """
    spark = prepared(stream.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy("writer_id").transformWithStateInPandas(LastSeq(), stream.schema, "Append", "None")


def deduplicated_within(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """The same by built-in state that forgets: repetitions later than `delay` are taken as new."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["writer_id", "append_seq"])


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append", **trigger: Any) -> StreamingQuery:
    """Starts a query that hands every micro-batch to `each`, which must take a repeated batch as one."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()


def materialize(stream: DataFrame, table: LogTable, checkpoint: str, epoch: int = 1, **trigger: Any) -> StreamingQuery:
    """Appends each micro-batch's segments (topic, batch_id, ...) to the table, once."""
    return run(stream, checkpoint, lambda df, _: table.append(df, epoch) and None, **trigger)


def tail(stream: DataFrame, checkpoint: str, path: str, **trigger: Any) -> StreamingQuery:
    """Writes records as JSON lines (offset, key, value); what isn't UTF-8 is replaced."""
    lines = stream.select(F.to_json(F.struct(F.col("_offset").alias("offset"), F.expr("try_validate_utf8(string(key))").alias("key"), F.expr("make_valid_utf8(string(value))").alias("value"))).alias("value"))
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A Parquet folder or file as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)
