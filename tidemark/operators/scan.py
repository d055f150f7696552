"""Reading the log: index scans within a byte budget, record fetches, watermarks, lookups, schema runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most index rows of one scan of a broker, and of a poll.
SCAN_ROWS, POLL_ROWS = 256, 10


def overlaps(lo: int | Column, hi: int | Column | None = None) -> Column:
    """Segments that hold an offset of [lo, hi)."""
    c = F.col("end_offset") > lo
    return c if hi is None else c & (F.col("start_offset") < hi)


def budget_scan(index: DataFrame, start: int, max_bytes: int, end: int | None = None, rows: int | None = SCAN_ROWS, topic: str = "topic") -> DataFrame:
    """Each topic's first segments from `start` on: those whose predecessors sum up to less than max_bytes.

    So the segment that crosses the budget is included, and a read always makes progress. A broker's scan ends after
    `rows` too, and its reader goes on from there; with None only the bytes count.
    """
    w = Window.partitionBy(topic).orderBy("start_offset")
    found = index.filter(overlaps(start, end)).withColumn("_before", F.coalesce(F.sum("byte_length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if rows is not None:
        found = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= rows)
    return found.filter(F.col("_before") < max_bytes).drop("_n", "_before")


def fetch(records: DataFrame, chosen: DataFrame, key: Sequence[str], start: int, max_bytes: int, size: str, end: int | None = None, topic: str = "topic") -> DataFrame:
    """The records of chosen segments, clipped to [start, end), up to the one that crosses max_bytes.

    Running sums go over whole segments first, and over records only inside a segment.
    """
    clip = (F.col("_offset") >= start) & (F.lit(True) if end is None else F.col("_offset") < end)
    mine = records.join(chosen.select(*key), list(key), "left_semi").filter(clip)
    per = mine.groupBy(*key).agg(F.sum(size).alias("_bytes"), F.min("_offset").alias("_first"))
    earlier = F.coalesce(F.sum("_bytes").over(Window.partitionBy(topic).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_earlier", earlier).select(*key, "_earlier").filter(F.col("_earlier") < max_bytes)
    within = F.coalesce(F.sum(size).over(Window.partitionBy(*key).orderBy("_offset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = mine.withColumn("_within", within).join(per, list(key))
    return out.filter(F.col("_earlier") + F.col("_within") < max_bytes).drop("_earlier", "_within")


def high_watermark(topics: DataFrame, index: DataFrame, topic: str = "topic") -> DataFrame:
    """The next offset of every topic; 0 if it has no segment."""
    top = index.groupBy(topic).agg(F.max("end_offset").alias("_end"))
    return topics.select(topic).join(top, topic, "left").select(topic, F.coalesce("_end", F.lit(0)).cast("bigint").alias("high_watermark"))


def segment_of(points: DataFrame, index: DataFrame, topic: str = "topic", offset: str = "offset") -> DataFrame:
    """Adds the segment (start_offset, end_offset) that holds each point (topic, offset), or nulls.

    An as-of join by union and last value: linear in both sides, where a range condition would pair every
    point with every segment of its topic.
    """
    seg = index.select(topic, F.col("start_offset").alias("_at"), F.struct("start_offset", "end_offset").alias("_seg"), F.lit(0).alias("_kind"), *[F.lit(None).cast(t).alias(c) for c, t in points.dtypes if c != topic])
    pts = points.select(topic, F.col(offset).alias("_at"), F.lit(None).cast(seg.schema["_seg"].dataType).alias("_seg"), F.lit(1).alias("_kind"), *[c for c in points.columns if c != topic])
    w = Window.partitionBy(topic).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = seg.unionByName(pts).withColumn("_last", F.last("_seg", ignorenulls=True).over(w)).filter("_kind = 1")
    inside = F.col("_last.end_offset") > F.col(offset)
    return found.select(*points.columns, F.when(inside, F.col("_last.start_offset")).alias("start_offset"), F.when(inside, F.col("_last.end_offset")).alias("end_offset"))


def schema_runs(records: DataFrame, key: str = "topic", schema: str = "schema_id") -> DataFrame:
    """Runs of neighbouring offsets with one schema: first and last offset, and records."""
    w = Window.partitionBy(key).orderBy("_offset")
    new = F.when(F.lag(schema).over(w) == F.col(schema), 0).otherwise(1)
    runs = records.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(key, "_run", schema).agg(F.min("_offset").alias("first_offset"), F.max("_offset").alias("last_offset"), F.count("*").alias("records")).drop("_run")


def bounded_tail(records: DataFrame, order: Sequence[Column], rows: int = 10_000) -> DataFrame:
    """The last rows: a top-k, which never sorts the whole input."""
    return records.orderBy(*order).limit(rows)


def json_lines(records: DataFrame, offset: str, key: str, value: str) -> DataFrame:
    """One JSON object a record, nulls written out."""
    return records.select(F.to_json(F.struct(F.col(offset).alias("offset"), F.col(key).alias("key"), F.col(value).alias("value")), {"ignoreNullFields": "false"}).alias("line"))
