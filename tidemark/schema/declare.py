"""Schemas as code: a decorated dataclass is an Avro record.

Fields may be null unless marked NonNull, and then null is their default.
"""

from __future__ import annotations

import dataclasses
import enum
import types
import typing
from typing import Annotated, Any, Union, get_args, get_origin, get_type_hints

from .compat import SchemaError


class NonNull:
    """Annotated[T, NonNull]: the field must have a value."""


class Int32:
    """Annotated[int, Int32]: a 32-bit integer."""


class Float32:
    """Annotated[float, Float32]: a 32-bit number."""


_SIMPLE = {str: "string", int: "long", float: "double", bool: "boolean", bytes: "bytes"}


def schema(cls: type | None = None, *, renames: dict[str, str] | None = None, deletions: tuple[str, ...] = ()) -> Any:
    """Makes cls a dataclass with `avro()`. renames: old name to new; deletions: names that are gone."""

    def make(c: type) -> type:
        c = dataclasses.dataclass(c)
        c._renames, c._deletions = dict(renames or {}), list(deletions)
        c.avro = classmethod(lambda k: record(k))
        record(c)  # errors show at once
        return c

    return make(cls) if cls else make


def record(cls: type, open_: tuple[type, ...] = ()) -> dict:
    if cls in open_:
        raise SchemaError(f"{cls.__name__} contains itself")
    hints = get_type_hints(cls, include_extras=True)
    names = [f.name for f in dataclasses.fields(cls)]
    renames, deletions = getattr(cls, "_renames", {}), getattr(cls, "_deletions", [])
    for old, new in renames.items():
        if new not in names:
            raise SchemaError(f"renamed to {new}, which isn't a field")
        if old in deletions:
            raise SchemaError(f"{old} is both renamed and deleted")
    for d in deletions:
        if d in names:
            raise SchemaError(f"{d} is deleted but still a field")
    fields = []
    for f in dataclasses.fields(cls):
        hint, marks = _unwrapped(hints[f.name])
        t = avro_type(hint, marks, (*open_, cls))
        out: dict[str, Any] = {"name": f.name}
        if NonNull in marks:
            out["type"] = t
            if f.default is not dataclasses.MISSING and f.default is not None:
                out["default"] = f.default.value if isinstance(f.default, enum.Enum) else f.default
        else:
            out |= {"type": ["null", t], "default": None}
        if aliases := [old for old, new in renames.items() if new == f.name]:
            out["aliases"] = aliases
        fields.append(out)
    found: dict[str, Any] = {"type": "record", "name": cls.__name__, "fields": fields}
    return found | ({"tidemark.renames": renames} if renames else {}) | ({"tidemark.deletions": deletions} if deletions else {})


def _unwrapped(hint: Any) -> tuple[Any, set]:
    """The type itself and its marks, without Optional."""
    marks: set = set()
    while True:
        if get_origin(hint) is Annotated:
            marks |= {m if isinstance(m, type) else type(m) for m in hint.__metadata__}
            hint = get_args(hint)[0]
        elif get_origin(hint) in (Union, types.UnionType):
            rest = [a for a in get_args(hint) if a is not type(None)]
            if len(rest) != 1:
                raise SchemaError(f"union of {len(rest)} types")
            hint = rest[0]
        else:
            return hint, marks


def avro_type(hint: Any, marks: set, open_: tuple[type, ...]) -> Any:
    if Int32 in marks and hint is int:
        return "int"
    if Float32 in marks and hint is float:
        return "float"
    if hint in _SIMPLE:
        return _SIMPLE[hint]
    if get_origin(hint) is list:
        return {"type": "array", "items": avro_type(*_unwrapped(get_args(hint)[0]), open_)}
    if get_origin(hint) is dict:
        key, value = get_args(hint)
        if key is not str:
            raise SchemaError("keys of a map are strings")
        return {"type": "map", "values": avro_type(*_unwrapped(value), open_)}
    if isinstance(hint, type) and issubclass(hint, enum.Enum):
        values = [m.value for m in hint]
        if not all(isinstance(v, str) for v in values):
            raise SchemaError("values of an enum are strings")
        return {"type": "enum", "name": hint.__name__, "symbols": values}
    if dataclasses.is_dataclass(hint):
        return record(typing.cast(type, hint), open_)
    raise SchemaError(f"no Avro type for {hint!r}")
