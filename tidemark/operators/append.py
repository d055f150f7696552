"""Appending to the log: segments, gap-free offsets, acknowledgements, idempotence.

Offsets are given to segments, not to records: one prefix sum runs over the small segment index, and a
record's offset is its segment's start plus its place in the segment. So no window ever spans all records of
a topic, however hot the topic is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import prepared

#: Fixed values of the log's protocol.
SEGMENT_MAX_BYTES = 256 << 20
FLUSH_MAX_BYTES, FLUSH_MAX_MS = 256 << 20, 200
PRESSURE_ON, PRESSURE_OFF = 384 << 20, 128 << 20
WRITER_TTL_HOURS = 24


def record_size(key: Column, value: Column) -> Column:
    """Bytes of a record; a null key has none."""
    return F.coalesce(F.octet_length(key), F.lit(0)) + F.octet_length(value)


def segments(records: DataFrame, key: Sequence[str], flush: str, size: str) -> DataFrame:
    """One row for each key and flush: record_count and byte_length."""
    return records.groupBy(*key, flush).agg(F.count("*").alias("record_count"), F.sum(size).cast("bigint").alias("byte_length"))


def topic_deltas(index: DataFrame, topic: str = "topic") -> DataFrame:
    return index.groupBy(topic).agg(F.sum("record_count").cast("bigint").alias("delta"))


def allocate(index: DataFrame, order: Sequence[str], topic: str = "topic", base: DataFrame | None = None) -> DataFrame:
    """Adds start_offset and end_offset (exclusive) to segments. base: (topic, next_offset) so far."""
    w = Window.partitionBy(topic).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("record_count").over(w)
    if base is not None:
        index = index.join(base.select(topic, F.col("next_offset").alias("_base")), topic, "left")
        end = end + F.coalesce("_base", F.lit(0))
    out = index.withColumn("end_offset", end.cast("bigint")).withColumn("start_offset", F.col("end_offset") - F.col("record_count"))
    return out.drop("_base")


def with_offsets(records: DataFrame, index: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds _offset to records: the segment's start plus the place in the segment."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    starts = index.select(*key, F.col("start_offset").alias("_start"))
    return records.withColumn("_place", place).join(starts, list(key)).withColumn("_offset", (F.col("_start") + F.col("_place")).cast("bigint")).drop("_start", "_place")


def acks(requests: DataFrame, index: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each request's own range inside its segment. requests: key columns and n (records), one row a request."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = requests.withColumn("_before", before).join(index.select(*key, F.col("start_offset").alias("_start")), list(key))
    first = F.col("_start") + F.col("_before")
    return joined.withColumn("start_offset", first.cast("bigint")).withColumn("end_offset", (first + F.col("n")).cast("bigint")).drop("_before", "_start")


def dedup_outcome(appends: DataFrame, state: DataFrame, writer: str = "writer_id", seq: str = "append_seq") -> DataFrame:
    """Adds outcome: duplicate (the writer's last one again), stale (older) or accept. state: (writer, last_seq)."""
    joined = appends.join(state.select(writer, "last_seq"), writer, "left")
    case = F.when(F.col(seq) == F.col("last_seq"), "duplicate").when(F.col(seq) < F.col("last_seq"), "stale").otherwise("accept")
    return joined.withColumn("outcome", case)


def admit_stale(outcomes: DataFrame, in_flight: DataFrame, writer: str = "writer_id", seq: str = "append_seq") -> DataFrame:
    """A stale append is admitted after all while a higher one of the same writer is in flight."""
    highest = in_flight.groupBy(writer).agg(F.max(seq).alias("_highest"))
    ok = (F.col("outcome") == "accept") | ((F.col("outcome") == "stale") & (F.col("_highest") > F.col(seq)))
    return outcomes.join(highest, writer, "left").withColumn("admitted", F.coalesce(ok, F.lit(False))).drop("_highest")


def coalesce_in_flight(appends: DataFrame, order: str, writer: str = "writer_id", seq: str = "append_seq") -> DataFrame:
    """Adds leader: the request (smallest `order`) whose outcome all repetitions of (writer, seq) share."""
    return appends.withColumn("leader", F.min(order).over(Window.partitionBy(writer, seq)))


def upsert_writers(state: DataFrame, done: DataFrame, writer: str = "writer_id", seq: str = "append_seq") -> DataFrame:
    """(writer, last_seq) after appends are committed; a writer's number never goes back."""
    new = done.groupBy(writer).agg(F.max(seq).alias("last_seq"))
    both = state.select(writer, "last_seq").unionByName(new)
    return both.groupBy(writer).agg(F.max("last_seq").alias("last_seq"))


def live_writers(state: DataFrame, now: Column, updated: str = "updated_at", hours: int = WRITER_TTL_HOURS) -> DataFrame:
    """Writer states less those that haven't changed for `hours`."""
    return state.filter(F.col(updated) >= now - F.expr(f"INTERVAL {hours} HOURS"))


def pressure(buffered: DataFrame, order: str, size: str, key: Sequence[str] = (), on: int = PRESSURE_ON, off: int = PRESSURE_OFF) -> DataFrame:
    """Adds pressed: on from a size of `on` until one of `off` or less. The last decisive size decides."""
    decisive = F.when(F.col(size) >= on, True).when(F.col(size) <= off, False)
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return buffered.withColumn("pressed", F.coalesce(F.last(decisive, ignorenulls=True).over(w), F.lit(False)))


def _folded(records: DataFrame, key: Sequence[str], order: Sequence[str], sizes: Sequence[str], name: str, fold: Callable[[], Callable[..., int]]) -> DataFrame:
    """Adds a number to each record that depends on those before it in its key: fold() makes the step of a new key,
    which is called with each record's `sizes` in order.

    Spark sorts, and spills if it must; records then pass through batch by batch, so a worker holds one batch however
    many records a key has. A key is one task's, as each number depends on the one before.
    """
    prepared(records.sparkSession)
    names = [*records.columns, name]
    keys_at, sizes_at = [records.columns.index(c) for c in key], [records.columns.index(c) for c in sizes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for b in batches:
            keys = zip(*(b.column(i).to_pylist() for i in keys_at), strict=True)
            # a null is neither too large nor too old, as in SQL
            values = zip(*([math.nan if v is None else v for v in b.column(i).to_pylist()] for i in sizes_at), strict=True)
            out = []
            for k, v in zip(keys, values, strict=True):
                if k != last:
                    last, step = k, fold()
                out.append(step(*v))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names)

    dealt = records.repartition(*key).sortWithinPartitions(*key, *[F.col(c).asc_nulls_last() for c in order])
    return dealt.mapInArrow(run, records.withColumn(name, F.lit(0).cast("bigint")).schema)


def _split(limit: int) -> Callable[[int], int]:
    chunk, held = 0, None

    def step(n: int) -> int:
        nonlocal chunk, held
        if held is not None and held + n > limit:
            chunk, held = chunk + 1, 0
        held = (held or 0) + n
        return chunk

    return step


def split_segments(records: DataFrame, key: Sequence[str], order: Sequence[str], size: str, limit: int = SEGMENT_MAX_BYTES) -> DataFrame:
    """Adds chunk: segments are cut before the record that would take them over `limit`; one record always fits.

    Each cut depends on the one before, so a flush of one key is folded in order.
    """
    return _folded(records, key, order, [size], "chunk", lambda: _split(limit))


def _flushes(max_bytes: int, max_ms: int) -> Callable[[int, int], int]:
    flush, held, first = 0, 0, None

    def step(t: int, n: int) -> int:
        nonlocal flush, held, first
        if first is not None and (held >= max_bytes or t - first >= max_ms):
            flush, held, first = flush + 1, 0, None
        first = t if first is None else first
        held += n
        return flush

    return step


def assign_flushes(records: DataFrame, broker: str, order: Sequence[str], ms: str, size: str, max_bytes: int = FLUSH_MAX_BYTES, max_ms: int = FLUSH_MAX_MS) -> DataFrame:
    """Adds flush_id: a broker's buffer goes out once it holds max_bytes or its first record is max_ms old."""
    return _folded(records, [broker], order, [ms, size], "flush_id", lambda: _flushes(max_bytes, max_ms))
