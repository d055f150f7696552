"""Avro values as JSON and back, and names of stored objects."""

from __future__ import annotations

import base64
import datetime as dt
import json
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .avro import AvroError, Codec


def object_key(prefix: str, time: Column, instance: Column, counter: Column) -> Column:
    """prefix/yyyy-mm-dd/<milliseconds>-<16 hex digits of the instance>-<counter>.fl"""
    millis = F.unix_millis(time.cast("timestamp"))
    return F.concat_ws("/", F.lit(prefix), F.date_format(time, "yyyy-MM-dd"), F.concat(F.concat_ws("-", millis, F.lower(F.lpad(F.hex(instance), 16, "0")), counter), F.lit(".fl")))


def to_json(schema: Any, data: bytes) -> str:
    """One Avro value as JSON: bytes in base64, times in ISO form, decimals as text."""

    def plain(v: Any) -> Any:
        if isinstance(v, bytes):
            return base64.b64encode(v).decode()
        if isinstance(v, (dt.date, dt.datetime)):
            return v.isoformat()
        return str(v) if isinstance(v, Decimal) else list(v)

    return json.dumps(Codec(schema).decode(data), default=plain, ensure_ascii=False)


def from_json(schema: dict, text: str) -> bytes:
    """JSON as one Avro value: unknown fields are refused, missing ones get their default, null comes first in unions."""
    codec = Codec(schema)

    def shaped(s: Any, v: Any) -> Any:
        s = codec.names.get(s, s) if isinstance(s, str) else s
        if isinstance(s, list):
            if v is None and "null" in s:
                return None
            for b in s:
                try:
                    out = shaped(b, v)
                except AvroError:
                    continue
                if codec.fits(b, out):
                    return out
            raise AvroError(f"no branch for {v!r}")
        kind = s["type"] if isinstance(s, dict) else s
        if isinstance(kind, (dict, list)):
            return shaped(kind, v)
        if kind == "record":
            if not isinstance(v, dict):
                raise AvroError(f"{v!r} is no record")
            if unknown := set(v) - {f["name"] for f in s["fields"]}:
                raise AvroError(f"unknown fields {sorted(unknown)}")
            out = {}
            for f in s["fields"]:
                if f["name"] in v:
                    out[f["name"]] = shaped(f["type"], v[f["name"]])
                elif "default" in f:
                    out[f["name"]] = f["default"]
                elif codec.fits(f["type"], None):
                    out[f["name"]] = None
                else:
                    raise AvroError(f"no value for {f['name']}")
            return out
        if kind == "array" and isinstance(v, list):
            return [shaped(s["items"], x) for x in v]
        if kind == "map" and isinstance(v, dict):
            return {k: shaped(s["values"], x) for k, x in v.items()}
        if kind in ("bytes", "fixed") and isinstance(v, str):
            return base64.b64decode(v)
        if not codec.fits(s, v):
            raise AvroError(f"{v!r} isn't of type {kind}")
        return v

    return codec.encode(shaped(codec.schema, json.loads(text)))
