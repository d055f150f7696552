"""Hashes that identify schemas."""

from __future__ import annotations

import hashlib
import json
from typing import Any

#: Fixed: the seed of the 64-bit Rabin fingerprint.
EMPTY = 0xC15D213AA4D7A795


def canonical(schema: Any) -> str:
    """Compact JSON with sorted keys and without `doc` entries, which don't change meaning; defaults stay."""

    def pruned(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: pruned(v) for k, v in x.items() if k != "doc"}
        return [pruned(v) for v in x] if isinstance(x, list) else x

    value = json.loads(schema) if isinstance(schema, str) else schema
    return json.dumps(pruned(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def schema_hash(schema: Any) -> str:
    return hashlib.sha256(canonical(schema).encode()).hexdigest()


def parsing_form(schema: Any) -> str:
    """Avro's parsing canonical form: full names, only the attributes that matter to a reader, in fixed order."""

    def form(s: Any, space: str) -> Any:
        if isinstance(s, list):
            return [form(x, space) for x in s]
        if isinstance(s, str):
            return s
        kind = s["type"]
        if kind not in ("record", "enum", "fixed", "array", "map"):
            return form(kind, space)
        out: dict[str, Any] = {}
        if "name" in s:
            space = s.get("namespace", s["name"].rpartition(".")[0] or space)
            out["name"] = s["name"] if "." in s["name"] or not space else f"{space}.{s['name']}"
        out["type"] = kind
        if kind == "record":
            out["fields"] = [{"name": f["name"], "type": form(f["type"], space)} for f in s["fields"]]
        for k in ("symbols", "size"):
            if k in s:
                out[k] = s[k]
        for k in ("items", "values"):
            if k in s:
                out[k] = form(s[k], space)
        return out

    return json.dumps(form(json.loads(schema) if isinstance(schema, str) and schema.lstrip()[:1] in '{["' else schema, ""), separators=(",", ":"), ensure_ascii=False)


def _table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (EMPTY if i % 2 else 0)
        out.append(i)
    return out


_TABLE = _table()


def fingerprint(schema: Any) -> int:
    """Rabin-64 of the parsing canonical form."""
    h = EMPTY
    for b in parsing_form(schema).encode():
        h = (h >> 8) ^ _TABLE[(h ^ b) % 256]
    return h
