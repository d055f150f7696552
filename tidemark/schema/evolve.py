"""Schemas as table columns: types, evolution steps, and the projection from writer to reader."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .compat import SchemaError, load, nullable

#: Fixed: columns that every table of the log has, and their field ids.
#: Of the properties in which a schema declares renames and deletions.
PREFIX = "tidemark"
METADATA = [("_offset", T.LongType(), False, 10000), ("_partition_id", T.IntegerType(), False, 10001), ("_ingest_time", T.TimestampType(), False, 10002), ("_key", T.BinaryType(), True, 10003)]
_SIMPLE = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}
_LOGICAL = {"uuid": T.StringType(), "date": T.DateType(), "big-decimal": T.StringType(), "duration": T.StructType([T.StructField(n, T.LongType()) for n in ("months", "days", "milliseconds")])}


def column_type(s: Any) -> T.DataType:
    """The Spark type of an Avro type; times stay numbers, as Parquet tables can't hold them here."""
    if isinstance(s, list):
        rest = [b for b in s if b != "null"]
        if len(rest) != 1:
            raise SchemaError("only unions of null and one type have a column")
        return column_type(rest[0])
    if isinstance(s, str):
        if s not in _SIMPLE:
            raise SchemaError(f"no column for the named type {s}")
        return _SIMPLE[s]
    kind, logical = s["type"], s.get("logicalType", "")
    if isinstance(kind, (dict, list)):
        return column_type(kind)
    if logical == "decimal":
        return T.DecimalType(s["precision"], s.get("scale", 0))
    if logical in _LOGICAL:
        return _LOGICAL[logical]
    if "timestamp-" in logical:
        return T.TimestampNTZType() if logical.startswith("local-") else T.TimestampType()
    if kind == "record":
        return T.StructType([T.StructField(f["name"], column_type(f["type"]), nullable(f["type"])) for f in s["fields"]])
    if kind == "array":
        return T.ArrayType(column_type(s["items"]), nullable(s["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), column_type(s["values"]), nullable(s["values"]))
    return {"enum": T.StringType(), "fixed": T.BinaryType()}.get(kind) or _SIMPLE[kind]


def table_type(schema: Any, metadata: bool = True) -> T.StructType:
    """The columns of a record schema, with field ids in pre-order from 1, and the metadata columns."""
    s = load(schema)
    if not isinstance(s, dict) or s.get("type") != "record":
        raise SchemaError("a table needs a record")
    number = iter(range(1, 10_000))

    def ids(t: Any) -> int:
        """Gives numbers to everything inside a type."""
        for b in t if isinstance(t, list) else [t]:
            if isinstance(b, dict):
                for f in b.get("fields", []):
                    next(number)
                    ids(f["type"])
                if "items" in b:
                    next(number)
                    ids(b["items"])
                if "values" in b:
                    next(number), next(number)
                    ids(b["values"])
        return 0

    out = []
    for f in s["fields"]:
        out.append(T.StructField(f["name"], column_type(f["type"]), nullable(f["type"]), {"field_id": next(number)}))
        ids(f["type"])
    extra = [T.StructField(n, t, null, {"field_id": i}) for n, t, null, i in METADATA] if metadata else []
    return T.StructType(out + extra)


@dataclass(frozen=True)
class Step:
    """rename (name, to), delete (name), widen (name, type) or add (name, type, default)."""

    what: str
    name: str
    to: str | None = None
    type: T.DataType | None = None
    default: Any = None


def evolution(new: Any, old: Any, prefix: str = PREFIX) -> list[Step]:
    """The steps from an old table to a new schema: renames and deletions it declares, then widenings and additions.

    A field that is only missing, without being declared deleted, stays in the table. `prefix` is that of the
    schema's properties that declare renames and deletions.
    """
    n, o = load(new), load(old)
    have = {f["name"]: f for f in o["fields"]}
    renames = {a: b for a, b in n.get(f"{prefix}.renames", {}).items() if a in have}
    deleted = [d for d in n.get(f"{prefix}.deletions", []) if d in have]
    steps = [Step("rename", a, b) for a, b in renames.items()] + [Step("delete", d) for d in deleted]
    now = {renames.get(name, name): f for name, f in have.items() if name not in deleted}
    for f in n["fields"]:
        t = column_type(f["type"])
        if f["name"] not in now:
            steps.append(Step("add", f["name"], type=t, default=f.get("default")))
        elif (was := column_type(now[f["name"]]["type"])) != t and _widens(was, t):
            steps.append(Step("widen", f["name"], type=t))
    return steps


def _widens(a: T.DataType, b: T.DataType) -> bool:
    return (a, b) in ((T.IntegerType(), T.LongType()), (T.FloatType(), T.DoubleType()))


def apply(df: DataFrame, steps: list[Step]) -> DataFrame:
    for s in steps:
        if s.what == "rename":
            df = df.withColumnRenamed(s.name, s.to)
        elif s.what == "delete":
            df = df.drop(s.name)
        elif s.what == "widen":
            df = df.withColumn(s.name, F.col(s.name).cast(s.type))
        else:
            df = df.withColumn(s.name, F.lit(s.default).cast(s.type))
    return df


def projection(reader: Any, writer: Any, prefix: str = PREFIX) -> list[Column]:
    """The reader's columns, made from the writer's: by name or alias, promoted, else default, else null.

    Aliases and renames are those of the reader, which is the schema that knows of the change.
    """
    r, w = load(reader), load(writer)
    have = {f["name"] for f in w["fields"]}
    before = {b: a for a, b in r.get(f"{prefix}.renames", {}).items()}
    out = []
    for f in r["fields"]:
        t = column_type(f["type"])
        source = next((x for x in (f["name"], *f.get("aliases", []), before.get(f["name"])) if x in have), None)
        out.append((F.col(f"`{source}`") if source else F.lit(f.get("default"))).cast(t).alias(f["name"]))
    return out


def with_metadata(df: DataFrame, offset: Column, partition: Column, ingest_time: Column, key: Column) -> DataFrame:
    """Adds the metadata columns; the partition is the topic's number, as topics have no partitions."""
    values = dict(zip([m[0] for m in METADATA], (offset, partition, ingest_time, key), strict=True))
    return df.withColumns({n: values[n].cast(t) for n, t, _, _ in METADATA})
