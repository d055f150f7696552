"""Whether data of an old schema can be read with a new one, within what tables can hold."""

from __future__ import annotations

import json
from typing import Any

from ..functions.avro import AvroError, parse

#: Fixed: the promotions that tables and log have in common.
PROMOTIONS = {("int", "long"), ("float", "double")}


class SchemaError(Exception):
    code = 42201


class Incompatible(SchemaError):
    code = 40901


class NotFound(SchemaError):
    code = 40401


class TopicNotFound(SchemaError):
    code = 40402


class InvalidAvro(SchemaError):
    code = 42202


def load(schema: Any) -> Any:
    try:
        s = json.loads(schema) if isinstance(schema, str) else schema
        s = parse(s)
    except (ValueError, KeyError, TypeError, AvroError) as e:
        raise InvalidAvro(str(e)) from e
    _check_unions(s)
    return s


def _check_unions(s: Any) -> None:
    """A union is null and one type: nothing else has a column."""
    if isinstance(s, list):
        if len(s) > 2 or (len(s) == 2 and "null" not in s):
            raise SchemaError(f"union of {len(s)} types")
        for x in s:
            _check_unions(x)
    elif isinstance(s, dict):
        for f in s.get("fields", []):
            _check_unions(f["type"])
        for k in ("items", "values"):
            if k in s:
                _check_unions(s[k])
        if isinstance(s.get("type"), (dict, list)):
            _check_unions(s["type"])


def nullable(t: Any) -> bool:
    return isinstance(t, list) and "null" in t


def backward_compatible(new: Any, old: Any) -> bool:
    """Whether a reader of `new` can read what was written with `old`."""
    return reads(load(new), load(old))


def reads(reader: Any, writer: Any) -> bool:
    if isinstance(writer, list):
        branches = writer if isinstance(reader, list) else [b for b in writer if b != "null"]
        return all(reads(reader, b) for b in branches)
    if isinstance(reader, list):
        return any(reads(b, writer) for b in reader)
    r, w = _kind(reader), _kind(writer)
    if r == w == "record":
        return _record(reader, writer)
    if r == w == "array":
        return reads(reader["items"], writer["items"])
    if r == w == "map":
        return reads(reader["values"], writer["values"])
    if r == w == "enum":
        return set(writer["symbols"]) <= set(reader["symbols"])
    if r == w == "fixed":
        return reader["size"] == writer["size"] and reader.get("logicalType") == writer.get("logicalType")
    logical = [x.get("logicalType") if isinstance(x, dict) else None for x in (reader, writer)]
    return logical[0] == logical[1] and (r == w or (w, r) in PROMOTIONS)


def _kind(s: Any) -> Any:
    return s["type"] if isinstance(s, dict) else s


def _record(reader: dict, writer: dict) -> bool:
    found: dict[str, dict] = {}
    for f in reader["fields"]:
        for name in (f["name"], *f.get("aliases", [])):
            found.setdefault(name, f)
    matched = set()
    for f in writer["fields"]:
        if f["name"] in found:
            mine = found[f["name"]]
            matched.add(mine["name"])
            if not reads(mine["type"], f["type"]):
                return False
    return all(f["name"] in matched or "default" in f or nullable(f["type"]) for f in reader["fields"])
