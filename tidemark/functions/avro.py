"""Avro binary data, without the Avro package: schemas to reader and writer closures, made once per schema.

Logical types come out as Python and Arrow know them: decimal as Decimal, date and timestamps as date and
datetime, uuid as text, duration as (months, days, milliseconds), times as numbers of their unit.
"""

from __future__ import annotations

import datetime as dt
import json
import struct
import zlib
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from .codec import CodecError, Cursor, put_varint

#: Fixed limits against hostile data.
MAX_DEPTH, MAX_ITEMS = 64, 10**9
_EPOCH = dt.datetime(1970, 1, 1)
_DAY0 = dt.date(1970, 1, 1)
PRIMITIVES = {"null", "boolean", "int", "long", "float", "double", "bytes", "string"}

Reader = Callable[[Cursor, int], Any]
Writer = Callable[[bytearray, Any], None]


class AvroError(CodecError):
    pass


def parse(schema: str | dict | list) -> Any:
    if isinstance(schema, str) and schema.lstrip()[:1] in ("{", "[", '"'):
        schema = json.loads(schema)
    names: dict[str, Any] = {}
    _collect(schema, names)
    check_cycles(schema, names)
    return schema


def _collect(s: Any, names: dict[str, Any]) -> None:
    if isinstance(s, list):
        for x in s:
            _collect(x, names)
    elif isinstance(s, dict):
        kind = s.get("type")
        if kind in ("record", "enum", "fixed"):
            if "name" not in s:
                raise AvroError(f"{kind} without name")
            names[s["name"]] = s
        if kind == "record":
            if not isinstance(s.get("fields"), list):
                raise AvroError("record without fields")
            for f in s["fields"]:
                _collect(f["type"], names)
        elif kind == "array":
            _collect(s["items"], names)
        elif kind == "map":
            _collect(s["values"], names)
        elif isinstance(kind, (dict, list)):
            _collect(kind, names)


def check_cycles(schema: Any, names: dict[str, Any]) -> None:
    """A record that always holds itself has no finite value."""

    def visit(s: Any, open_: tuple[str, ...]) -> None:
        s = names.get(s, s) if isinstance(s, str) else s
        if isinstance(s, dict) and s.get("type") == "record":
            if s["name"] in open_:
                raise AvroError(f"{s['name']} always contains itself")
            for f in s["fields"]:
                visit(f["type"], (*open_, s["name"]))
        elif isinstance(s, dict) and isinstance(s.get("type"), dict):
            visit(s["type"], open_)

    visit(schema, ())


class Codec:
    """encode() and decode() of one schema."""

    def __init__(self, schema: str | dict | list):
        self.schema = parse(schema)
        self.names: dict[str, Any] = {}
        _collect(self.schema, self.names)
        self._readers: dict[str, Reader] = {}
        self._writers: dict[str, Writer] = {}
        self.read, self.write = self._reader(self.schema), self._writer(self.schema)

    def decode(self, data: bytes) -> Any:
        c = Cursor(data)
        out = self.read(c, 0)
        if c:
            raise AvroError(f"{len(c.data) - c.at} bytes left over")
        return out

    def decode_all(self, data: bytes) -> list[Any]:
        """Values written one after another; none is an error."""
        c, out = Cursor(data), []
        while c:
            at = c.at
            out.append(self.read(c, 0))
            if c.at == at:
                raise AvroError("a value of no bytes has no end")
        if not out:
            raise AvroError("no value")
        return out

    def encode(self, value: Any) -> bytes:
        out = bytearray()
        self.write(out, value)
        return bytes(out)

    # -- reading

    def _reader(self, s: Any) -> Reader:
        if isinstance(s, list):
            branches = [self._reader(b) for b in s]

            def union(c: Cursor, depth: int) -> Any:
                i = c.varint()
                if not 0 <= i < len(branches):
                    raise AvroError(f"union has no branch {i}")
                return branches[i](c, depth)

            return union
        if isinstance(s, str):
            if s in self.names:
                return lambda c, depth: self._named(s)(c, depth)
            return _PRIMITIVE_READERS[s] if s in _PRIMITIVE_READERS else _bad(s)
        kind = s["type"]
        if isinstance(kind, (dict, list)):
            return self._reader(kind)
        if (logical := _logical_reader(s)) is not None:
            return logical
        if kind == "record":
            fields = [(f["name"], self._reader(f["type"])) for f in s["fields"]]

            def record(c: Cursor, depth: int) -> dict:
                if depth > MAX_DEPTH:
                    raise AvroError(f"deeper than {MAX_DEPTH}")
                return {name: read(c, depth + 1) for name, read in fields}

            self._readers[s["name"]] = record
            return record
        if kind == "enum":
            symbols = s["symbols"]

            def enum(c: Cursor, depth: int) -> str:
                i = c.varint()
                if not 0 <= i < len(symbols):
                    raise AvroError(f"enum has no symbol {i}")
                return symbols[i]

            return enum
        if kind == "fixed":
            size = s["size"]
            return lambda c, depth: bytes(c.take(size))
        if kind == "array":
            item = self._reader(s["items"])
            return lambda c, depth: _blocks(c, depth, lambda: item(c, depth + 1))
        if kind == "map":
            value = self._reader(s["values"])
            return lambda c, depth: dict(_blocks(c, depth, lambda: (_text(c), value(c, depth + 1))))
        return self._reader(kind)

    def _named(self, name: str) -> Reader:
        if name not in self._readers:
            self._readers[name] = self._reader(self.names[name])
        return self._readers[name]

    # -- writing

    def _writer(self, s: Any) -> Writer:
        if isinstance(s, list):
            branches = [(b, self._writer(b)) for b in s]

            def union(out: bytearray, v: Any) -> None:
                for i, (b, write) in enumerate(branches):
                    if self.fits(b, v):
                        put_varint(out, i)
                        write(out, v)
                        return
                raise AvroError(f"no branch for {type(v).__name__}")

            return union
        if isinstance(s, str):
            if s in self.names:
                return lambda out, v: self._named_writer(s)(out, v)
            return _PRIMITIVE_WRITERS[s] if s in _PRIMITIVE_WRITERS else _bad(s)
        kind = s["type"]
        if isinstance(kind, (dict, list)):
            return self._writer(kind)
        if (logical := _logical_writer(s)) is not None:
            return logical
        if kind == "record":
            fields = [(f["name"], self._writer(f["type"]), f) for f in s["fields"]]

            def record(out: bytearray, v: dict) -> None:
                for name, write, f in fields:
                    if name not in v and "default" not in f and not self.fits(f["type"], None):
                        raise AvroError(f"no value for {name}")
                    write(out, v[name] if name in v else f.get("default"))

            self._writers[s["name"]] = record
            return record
        if kind == "enum":
            return lambda out, v: put_varint(out, s["symbols"].index(v))
        if kind == "fixed":
            return lambda out, v: out.extend(v)
        if kind == "array":
            item = self._writer(s["items"])
            return lambda out, v: _put_blocks(out, v, item)
        if kind == "map":
            value = self._writer(s["values"])

            def pair(out: bytearray, kv: tuple[str, Any]) -> None:
                _put_bytes(out, kv[0].encode())
                value(out, kv[1])

            return lambda out, v: _put_blocks(out, list(v.items()), pair)
        return self._writer(kind)

    def _named_writer(self, name: str) -> Writer:
        if name not in self._writers:
            self._writers[name] = self._writer(self.names[name])
        return self._writers[name]

    def fits(self, s: Any, v: Any) -> bool:
        """Whether a union branch takes the value; of several the first is used."""
        if isinstance(s, list):
            return any(self.fits(b, v) for b in s)
        s = self.names.get(s, s) if isinstance(s, str) else s
        kind = s["type"] if isinstance(s, dict) else s
        if isinstance(kind, (dict, list)):
            return self.fits(kind, v)
        logical = s.get("logicalType") if isinstance(s, dict) else None
        if logical and v is not None and not isinstance(v, (bool, int, str, bytes)):
            return isinstance(v, {"decimal": Decimal, "big-decimal": Decimal, "date": dt.date, "duration": tuple}.get(logical, dt.datetime))
        whole = isinstance(v, int) and not isinstance(v, bool)
        if kind == "record":
            return isinstance(v, dict) and set(v) <= {f["name"] for f in s["fields"]} and all(f["name"] in v or "default" in f or self.fits(f["type"], None) for f in s["fields"])
        if kind == "enum":
            return v in s["symbols"] if isinstance(v, str) else False
        if kind == "fixed":
            return isinstance(v, bytes) and len(v) == s["size"]
        return {
            "null": v is None,
            "boolean": isinstance(v, bool),
            "int": whole and -(2**31) <= v < 2**31,
            "long": whole and -(2**63) <= v < 2**63,
            "float": whole or isinstance(v, float),
            "double": whole or isinstance(v, float),
            "bytes": isinstance(v, bytes),
            "string": isinstance(v, str),
            "array": isinstance(v, list),
            "map": isinstance(v, dict),
        }.get(kind, False)


def _bad(name: Any) -> Any:
    raise AvroError(f"unknown type {name!r}")


def _boolean(c: Cursor, depth: int) -> bool:
    b = c.take(1)[0]
    if b > 1:
        raise AvroError(f"boolean {b}")
    return b == 1


def _text(c: Cursor, depth: int = 0) -> str:
    try:
        return str(c.take(c.varint()), "utf-8")
    except UnicodeDecodeError as e:
        raise AvroError("text isn't UTF-8") from e


def _blocks(c: Cursor, depth: int, one: Callable[[], Any]) -> list:
    """Blocks of items until one of length 0; a negative length has the block's bytes after it."""
    if depth > MAX_DEPTH:
        raise AvroError(f"deeper than {MAX_DEPTH}")
    out: list = []
    while n := c.varint():
        if n < 0:
            n = -n
            c.varint()
        if len(out) + n > MAX_ITEMS:
            raise AvroError(f"more than {MAX_ITEMS} items")
        out.extend(one() for _ in range(n))
    return out


def _put_blocks(out: bytearray, items: list, write: Writer) -> None:
    if items:
        put_varint(out, len(items))
        for x in items:
            write(out, x)
    out.append(0)


def _put_bytes(out: bytearray, v: bytes) -> None:
    put_varint(out, len(v))
    out += v


_PRIMITIVE_READERS: dict[str, Reader] = {
    "null": lambda c, d: None,
    "boolean": _boolean,
    "int": lambda c, d: c.varint(32),
    "long": lambda c, d: c.varint(64),
    "float": lambda c, d: struct.unpack("<f", c.take(4))[0],
    "double": lambda c, d: struct.unpack("<d", c.take(8))[0],
    "bytes": lambda c, d: bytes(c.take(c.varint())),
    "string": _text,
}
_PRIMITIVE_WRITERS: dict[str, Writer] = {
    "null": lambda out, v: None,
    "boolean": lambda out, v: out.append(bool(v)),
    "int": put_varint,
    "long": put_varint,
    "float": lambda out, v: out.extend(struct.pack("<f", v)),
    "double": lambda out, v: out.extend(struct.pack("<d", v)),
    "bytes": _put_bytes,
    "string": lambda out, v: _put_bytes(out, v.encode()),
}
#: Microseconds in a unit of each timestamp type.
_UNITS = {"millis": 1000, "micros": 1, "nanos": None}


def _signed(b: bytes) -> int:
    if len(b) > 16:
        raise AvroError("decimal of more than 16 bytes")
    return int.from_bytes(b, "big", signed=True)


def _two(n: int, size: int | None = None) -> bytes:
    return n.to_bytes(size or max(1, (n.bit_length() + 8) // 8), "big", signed=True)


def _logical_reader(s: dict) -> Reader | None:
    kind, logical = s["type"], s.get("logicalType", "")
    raw = (lambda c, d: bytes(c.take(s["size"]))) if kind == "fixed" else _PRIMITIVE_READERS.get(kind)
    if logical == "decimal" and kind in ("bytes", "fixed"):
        return lambda c, d: Decimal(_signed(raw(c, d))).scaleb(-s.get("scale", 0))
    if logical == "big-decimal" and kind == "bytes":

        def big(c: Cursor, d: int) -> Decimal:
            inner = Cursor(raw(c, d))
            n = _signed(bytes(inner.take(inner.varint())))
            return Decimal(n).scaleb(-inner.varint())

        return big
    if logical == "duration" and kind == "fixed":
        return lambda c, d: struct.unpack("<III", raw(c, d))
    if logical == "date" and kind == "int":
        return lambda c, d: _DAY0 + dt.timedelta(days=raw(c, d))
    if "timestamp-" in logical and kind == "long":
        unit = logical.rsplit("-", 1)[1]
        if unit in _UNITS:
            return lambda c, d: _EPOCH + dt.timedelta(microseconds=raw(c, d) * _UNITS[unit] if _UNITS[unit] else raw(c, d) // 1000)
    return None


def _logical_writer(s: dict) -> Writer | None:
    kind, logical = s["type"], s.get("logicalType", "")
    if logical == "decimal" and kind == "bytes":
        return lambda out, v: _put_bytes(out, _two(int(v.scaleb(s.get("scale", 0)))))
    if logical == "decimal" and kind == "fixed":
        return lambda out, v: out.extend(_two(int(v.scaleb(s.get("scale", 0))), s["size"]))
    if logical == "big-decimal" and kind == "bytes":

        def big(out: bytearray, v: Decimal) -> None:
            scale = max(0, -v.as_tuple().exponent)
            inner = bytearray()
            _put_bytes(inner, _two(int(v.scaleb(scale))))
            put_varint(inner, scale)
            _put_bytes(out, bytes(inner))

        return big
    if logical == "duration" and kind == "fixed":
        return lambda out, v: out.extend(struct.pack("<III", *v))
    if logical == "date" and kind == "int":
        return lambda out, v: put_varint(out, (v - _DAY0).days if isinstance(v, dt.date) else v)
    if "timestamp-" in logical and kind == "long":
        unit = logical.rsplit("-", 1)[1]
        if unit in _UNITS:
            one = dt.timedelta(microseconds=1)
            return lambda out, v: put_varint(out, v if isinstance(v, int) else (n := (v - _EPOCH) // one) // _UNITS[unit] if _UNITS[unit] else (v - _EPOCH) // one * 1000)
    return None


# --- object container files ---------------------------------------------------------------------------------

OCF_MAGIC = b"Obj\x01"
_META = Codec({"type": "map", "values": "bytes"})


def write_container(schema: str | dict, values: list[Any], sync: bytes = b"\x5a" * 16, block: int = 1000, codec: str = "deflate") -> bytes:
    c = Codec(schema)
    text = schema if isinstance(schema, str) else json.dumps(schema)
    out = bytearray(OCF_MAGIC) + _META.encode({"avro.schema": text.encode(), "avro.codec": codec.encode()}) + sync
    for i in range(0, len(values), block):
        part = values[i : i + block]
        data = b"".join(map(c.encode, part))
        if codec == "deflate":
            z = zlib.compressobj(wbits=-15)
            data = z.compress(data) + z.flush()
        put_varint(out, len(part))
        _put_bytes(out, data)
        out += sync
    return bytes(out)


def read_container(data: bytes) -> tuple[dict, list[Any]]:
    if data[:4] != OCF_MAGIC:
        raise AvroError("not a container file")
    c = Cursor(data, 4)
    meta = _META.read(c, 0)
    sync = bytes(c.take(16))
    schema = json.loads(meta["avro.schema"])
    codec, out = Codec(schema), []
    packing = meta.get("avro.codec", b"null").decode()
    if packing not in ("null", "deflate"):
        raise AvroError(f"unknown packing {packing}")
    while c:
        n = c.varint()
        block = bytes(c.take(c.varint()))
        inner = Cursor(zlib.decompress(block, -15) if packing == "deflate" else block)
        out += [codec.read(inner, 0) for _ in range(n)]
        if bytes(c.take(16)) != sync:
            raise AvroError("a block's end isn't where it should be")
    return schema, out
