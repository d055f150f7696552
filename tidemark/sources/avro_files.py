"""Avro data as DataFrames: values one after another, or object container files; and back."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.avro import Codec, read_container, write_container
from ..schema.evolve import projection, table_type
from ..session import prepared


def _table(rows: list[Any], t: T.StructType) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(t)
    cols = []
    for f in t.fields:
        v = [r[f.name] for r in rows]
        if isinstance(f.dataType, T.StringType):
            v = [str(x) if x is not None and not isinstance(x, str) else x for x in v]
        if isinstance(f.dataType, T.StructType) and any(isinstance(x, tuple) for x in v):
            v = [x if x is None else dict(zip(f.dataType.names, x, strict=True)) for x in v]
        cols.append(pa.array(v, schema.field(f.name).type))
    yield pa.RecordBatch.from_arrays(cols, schema=schema)


def decode_values(df: DataFrame, column: str, schema: Any, several: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The rows in a binary column of Avro values: one in each, or with `several` as many as there are.

    Null values give no row. Columns in `keep` come first, with the names they have.
    """
    t = table_type(schema, metadata=False)
    out = T.StructType([*(df.schema[k] for k in keep), *t.fields])
    prepared(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(schema)
        for b in batches:
            at = [i for i, x in enumerate(b.column(0).to_pylist()) if x is not None]
            data = [c.decode_all(x) if several else [c.decode(x)] for x in b.column(0).to_pylist() if x is not None]
            row = pa.array([i for i, x in zip(at, data, strict=True) for _ in x], pa.int64())
            for made in _table([r for x in data for r in x], t):
                yield pa.RecordBatch.from_arrays([*(b.column(1 + k).take(row) for k in range(len(keep))), *made.columns], [*keep, *made.schema.names])

    return df.select(column, *keep).mapInArrow(run, out)


def decode_mixed(df: DataFrame, column: str, schemas: dict[int, Any], reader: Any, schema_id: str = "schema_id", keep: Sequence[str] = ()) -> DataFrame:
    """The reader's rows in a binary column of Avro values, each written with the schema that its schema_id names.

    Every writer's rows are decoded by its own schema, brought to the reader's columns (names and aliases,
    promotions, defaults), and put together. Rows of an id that isn't in `schemas` raise an error.
    """
    known = F.col(schema_id).isin(list(schemas))
    checked = df.withColumn(column, F.when(known, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown schema "), F.coalesce(F.col(schema_id).cast("string"), F.lit("null")))).cast("binary")))
    first = min(schemas)
    parts = []
    for number, writer in schemas.items():
        own = checked.filter((F.col(schema_id) == number) | (F.lit(number == first) & ~F.coalesce(known, F.lit(False))))
        parts.append(decode_values(own, column, writer, keep=keep).select(*keep, *projection(reader, writer)))
    return reduce(DataFrame.unionByName, parts)


def encode_rows(df: DataFrame, schema: Any, keep: Sequence[str] = ()) -> DataFrame:
    """Each row as one Avro value, in a column `value` after those in `keep`."""
    names = [f["name"] for f in schema["fields"]]
    prepared(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(schema)
        for b in batches:
            rows = b.select(list(range(len(keep), b.num_columns))).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([c.encode(r) for r in rows], pa.binary())], [*keep, "value"])

    return df.select(*keep, *names).mapInArrow(run, T.StructType([*(df.schema[k] for k in keep), T.StructField("value", T.BinaryType())]))


def encode_containers(df: DataFrame, schema: Any, block: int = 1000) -> DataFrame:
    """The rows as container files, one for each Arrow batch, in a column `content`."""
    names = [f["name"] for f in schema["fields"]]
    prepared(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([write_container(schema, b.to_pylist(), block=block)], pa.binary())], ["content"])

    return df.select(*names).mapInArrow(run, "content binary")


def decode_containers(df: DataFrame, column: str, schema: Any) -> DataFrame:
    """The rows of container files in a binary column, whose own schema must have the fields of `schema`."""
    t = table_type(schema, metadata=False)
    prepared(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                yield from _table(read_container(data)[1], t)

    return df.select(column).mapInArrow(run, t)


def read_containers(spark: SparkSession, path: str, schema: Any) -> DataFrame:
    """The rows of container files below a path."""
    return decode_containers(spark.read.format("binaryFile").load(path), "content", schema)
