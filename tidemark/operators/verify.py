"""Invariants of a history of writes and reads, as queries that return the violations.

writes: (writer_id, topic, offset, value, start_time, end_time, success)
reads: (topic, reader_id, seq, requested_offset, values, high_watermark, start_time, end_time)
A correct history gives no row for any of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def observed(reads: DataFrame) -> DataFrame:
    """topic, offset and value of everything that was read."""
    out = reads.select("topic", "reader_id", "seq", "requested_offset", F.posexplode("values").alias("_i", "value"))
    return out.withColumn("offset", F.col("requested_offset") + F.col("_i")).drop("_i")


def lost_writes(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """Acknowledged but never read."""
    return writes.filter("success").join(observed(reads).select("topic", "offset", "value").distinct(), ["topic", "offset", "value"], "left_anti")


def shared_offsets(writes: DataFrame) -> DataFrame:
    """Offsets given to more than one write."""
    return writes.filter("success").groupBy("topic", "offset").agg(F.count("*").alias("n")).filter("n > 1")


def falling_watermarks(reads: DataFrame) -> DataFrame:
    """Reads that saw a lower watermark than the same reader's read before."""
    w = Window.partitionBy("topic", "reader_id").orderBy("seq")
    return reads.withColumn("before", F.lag("high_watermark").over(w)).filter("high_watermark < before").select("topic", "reader_id", "seq", "before", "high_watermark")


def duplicate_values(reads: DataFrame) -> DataFrame:
    """Values that stand at more than one offset of a topic."""
    return observed(reads).groupBy("topic", "value").agg(F.countDistinct("offset").alias("n")).filter("n > 1")


def poll_gaps(reads: DataFrame) -> DataFrame:
    """Reads that don't begin where the same reader's read before ended."""
    w = Window.partitionBy("topic", "reader_id").orderBy("seq")
    ended = F.lag(F.col("requested_offset") + F.size("values")).over(w)
    return reads.withColumn("expected", ended).filter("requested_offset <> expected").select("topic", "reader_id", "seq", "expected", "requested_offset")


def causal_violations(writes: DataFrame) -> DataFrame:
    """Writes that ended before another of their topic began, yet got a higher offset than it.

    A running maximum over end times (ends come before starts of the same moment) replaces the pairwise test.
    """
    ok = writes.filter("success")
    ends = ok.select("topic", F.col("end_time").alias("_t"), F.lit(0).alias("_kind"), F.col("offset").alias("_done"), F.lit(None).cast("bigint").alias("offset"))
    starts = ok.select("topic", F.col("start_time").alias("_t"), F.lit(-1).alias("_kind"), F.lit(None).cast("bigint").alias("_done"), "offset")
    w = Window.partitionBy("topic").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = ends.unionByName(starts).withColumn("highest_before", F.max("_done").over(w))
    return both.filter("_kind = -1 AND highest_before > offset").select("topic", "offset", "highest_before")


def unordered_sends(writes: DataFrame) -> DataFrame:
    """A writer's writes whose offsets don't rise in the order of sending."""
    w = Window.partitionBy("topic", "writer_id").orderBy("start_time", "offset")
    return writes.filter("success").withColumn("before", F.lag("offset").over(w)).filter("offset <= before").select("topic", "writer_id", "before", "offset")


def phantoms(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """Values that were read but that nobody tried to write."""
    return observed(reads).select("topic", "value").distinct().join(writes.select("topic", "value"), ["topic", "value"], "left_anti")
