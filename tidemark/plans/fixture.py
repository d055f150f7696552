"""The log that the driver tables stand for, as DataFrames and as SQL.

events: topic is event_type, writer is user_id, a flush is the hour, a record's bytes are length(props) + 8.
Times leave queries as text, as engines differ in how they type them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import append

KEY = ["topic", "flush_ts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_text(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("topic"), F.col("user_id").alias("writer_id"), F.expr("make_timestamp_ntz(year(ts), month(ts), day(ts), hour(ts), 0, 0)").alias("flush_ts"), (F.length("props") + 8).cast("bigint").alias("bytes"), "event_id", "ts", "value", "props")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments: topic, flush_ts, record_count, byte_length, start_offset, end_offset."""
    return append.allocate(append.segments(records(spark, sf_dir), ["topic"], "flush_ts", "bytes"), ["flush_ts"])


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with _offset."""
    return append.with_offsets(records(spark, sf_dir), index(spark, sf_dir), KEY, ["event_id"])


#: The topics of the driver's events; their places number them.
TOPICS = ["click", "error", "purchase", "signup", "view"]


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with ingest_time and a batch_id, which rises with the flush and tells topics apart."""
    number = F.array_position(F.array(*[F.lit(t) for t in TOPICS]), F.col("topic"))
    hours = F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', flush_ts)")
    return index(spark, sf_dir).withColumn("batch_id", (hours * 10 + number).cast("bigint")).withColumn("ingest_time", F.col("flush_ts"))


SQL = """
rec AS (SELECT event_type AS topic, user_id AS writer_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS flush_ts,
               CAST(length(props) + 8 AS BIGINT) AS bytes, event_id, ts, value, props FROM events),
cnt AS (SELECT topic, flush_ts, count(*) AS record_count, CAST(sum(bytes) AS BIGINT) AS byte_length FROM rec GROUP BY ALL),
seg AS (SELECT *, CAST(sum(record_count) OVER w AS BIGINT) AS end_offset,
               CAST(sum(record_count) OVER w AS BIGINT) - record_count AS start_offset
        FROM cnt WINDOW w AS (PARTITION BY topic ORDER BY flush_ts)),
log AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY flush_ts, event_id) - 1 AS _offset FROM rec),
bat AS (SELECT *, flush_ts AS ingest_time, CAST(epoch(flush_ts) / 3600 AS BIGINT) * 10 + list_position(['click', 'error', 'purchase', 'signup', 'view'], topic) AS batch_id FROM seg)
"""
