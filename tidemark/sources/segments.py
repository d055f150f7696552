"""Segment files as tables: reading them with pruning by topic and offset, and writing them from records.

Files are read through Spark's own binaryFile reader, so any store that Spark can read will do; decoding is an
Arrow map over files. The index, not the file's footer, says which offsets a segment has.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..session import prepared

INDEX = "s3_key string, topic_id int, schema_id int, record_count int, byte_offset bigint, byte_length bigint, ingest_ms bigint, crc32 bigint"
RECORDS = "topic_id int, schema_id int, _offset bigint, key binary, value binary"
#: Records in an Arrow batch that leaves a decoder.
BATCH = 8192


def write_segments(records: DataFrame, path: str) -> DataFrame:
    """Writes records (topic_id, schema_id, seg, place, ingest_ms, key, value) as segments, one row each, and
    returns the index of what was written.

    Segments are Parquet rows of compressed bytes below `path`, written by Spark's committer: a task that is
    run again leaves no second copy. A segment's records are bounded by the flush that made it.
    """
    prepared(records.sparkSession)
    schema = "topic_id int, schema_id int, seg bigint, record_count int, ingest_ms bigint, crc32 bigint, payload binary"

    def encode(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        data = list(zip(rows.column("key").to_pylist(), rows.column("value").to_pylist(), strict=True))
        payload, crc = codec.encode_segment(data)
        return pa.table([[k.as_py()] for k in key] + [[len(data)], [rows.column("ingest_ms")[0].as_py()], [crc], [payload]], schema=pa.schema([("topic_id", pa.int32()), ("schema_id", pa.int32()), ("seg", pa.int64()), ("record_count", pa.int32()), ("ingest_ms", pa.int64()), ("crc32", pa.int64()), ("payload", pa.binary())]))

    made = records.groupBy("topic_id", "schema_id", "seg").applyInArrow(encode, schema)
    made.write.mode("append").partitionBy("topic_id").option("compression", "uncompressed").parquet(path)
    return records.sparkSession.read.parquet(path)


def read_segments(segments: DataFrame, start: int | None = None, end: int | None = None, check: bool = True) -> DataFrame:
    """Records of segments (topic_id, schema_id, start_offset, end_offset, crc32, payload) within [start, end).

    Whole segments are left out by the index's offsets before anything is decoded.
    """
    prepared(segments.sparkSession)
    if start is not None:
        segments = segments.filter(F.col("end_offset") > start)
    if end is not None:
        segments = segments.filter(F.col("start_offset") < end)
    lo, hi = (start if start is not None else -(2**62)), (end if end is not None else 2**62)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for topic, schema, first, crc, payload in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                rows = codec.decode_segment(payload, crc if check else None)
                keep = [(topic, schema, o, k, v) for o, (k, v) in enumerate(rows, first) if lo <= o < hi]
                for i in range(0, len(keep), BATCH):
                    cols = list(zip(*keep[i : i + BATCH], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["topic_id", "schema_id", "_offset", "key", "value"])

    return segments.select("topic_id", "schema_id", "start_offset", "crc32", "payload").mapInArrow(decode, RECORDS)


def write_file(path: str, segments: list[tuple[int, int, int, list[codec.Record]]], spark: SparkSession) -> None:
    """One segment file (several segments and a footer) at a path of any Hadoop file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(codec.encode_file(segments))
    out.close()
    fs.rename(part, p)


def encode_files(records: DataFrame) -> DataFrame:
    """Segment files (path, content) of records (file, topic_id, schema_id, place, ingest_ms, key, value), made by
    executors: in each file a segment for each topic and schema, its records by place. A file is bounded by what a
    flush holds, as its writer's buffer is."""
    prepared(records.sparkSession)

    def encode(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("topic_id", "ascending"), ("schema_id", "ascending"), ("place", "ascending")])
        cols = {c: rows.column(c).to_pylist() for c in ("topic_id", "schema_id", "ingest_ms", "key", "value")}
        parts: dict[tuple, list] = {}
        for topic, schema, at, k, v in zip(*cols.values(), strict=True):
            parts.setdefault((topic, schema), [at, []])[1].append((k, v))
        content = codec.encode_file([(t, s, at, data) for (t, s), (at, data) in parts.items()])
        return pa.table([[key[0].as_py()], [content]], schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return records.groupBy("file").applyInArrow(encode, "path string, content binary")


def index_of(files: DataFrame) -> DataFrame:
    """The footers of files (path, content): one row a segment."""
    prepared(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield _entries(name, codec.read_footer(content))

    return files.select("path", "content").mapInArrow(read, INDEX)


def _entries(name: str, rows: list[codec.Entry], *payloads: list[bytes]) -> pa.RecordBatch:
    names = [x.split()[0] for x in INDEX.split(", ")]
    cols = [[name] * len(rows), *([getattr(e, k) for e in rows] for k in ("topic_id", "schema_id", "record_count", "byte_offset", "byte_length", "ingest_time", "crc32")), *payloads]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * len(payloads)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names + ["payload"] * len(payloads))


def segments_of(files: DataFrame) -> DataFrame:
    """The segments of files (path, content) with their compressed bytes, cut out where the file is: no file is shuffled."""
    prepared(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = codec.read_footer(content)
                yield _entries(name, rows, [content[e.byte_offset : e.byte_offset + e.byte_length] for e in rows])

    return files.select("path", "content").mapInArrow(read, INDEX + ", payload binary")


def file_index(spark: SparkSession, path: str) -> DataFrame:
    """The footers of segment files: one row a segment."""
    return index_of(spark.read.format("binaryFile").load(path))


def file_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of files with their compressed bytes, as a raw read gives them."""
    return segments_of(spark.read.format("binaryFile").load(path))
