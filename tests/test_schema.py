import enum
from typing import Annotated, Optional

import pytest
from pyspark.sql import types as T

from tidemark.plans.derived import _TYPES, V1, V2, _verdict
from tidemark.schema import canonical, compat, evolve
from tidemark.schema.declare import Float32, Int32, NonNull, schema
from tidemark.schema.registry import Registry


WRAPPED = {
    "items": lambda t: {"type": "array", "items": t},
    "values": lambda t: {"type": "map", "values": t},
    "record": lambda t: {"type": "record", "name": "Inner", "fields": [{"name": "x", "type": t}]},
    "deep": lambda t: {"type": "array", "items": {"type": "map", "values": t}},
}


@pytest.mark.parametrize("wrap", sorted(WRAPPED))
def test_compatibility_inside_other_types(wrap):
    """A type inside another is read like one alone: by itself, or widened."""
    widened = {"int": {"long"}, "float": {"double"}}
    for w in _TYPES:
        for r in _TYPES:
            new, old = (rec(field("k", "long"), field("a", WRAPPED[wrap](t))) for t in (r, w))
            assert _verdict(new, old) == str(w == r or r in widened.get(w, ())).lower(), (w, r)


def test_compatibility_of_enums():
    sets = [["N"], ["N", "E"], ["N", "E", "S"], ["E", "W"]]
    for w in sets:
        for r in sets:
            new, old = (rec(field("a", {"type": "enum", "name": "Wind", "symbols": x})) for x in (r, w))
            assert _verdict(new, old) == str(set(w) <= set(r)).lower()


def field(name, type_, **more):
    return {"name": name, "type": type_} | more


def rec(*fields):
    return {"type": "record", "name": "R", "fields": list(fields)}


def test_aliases():
    assert compat.backward_compatible(rec(field("b", "int", aliases=["a"])), rec(field("a", "int")))
    assert not compat.backward_compatible(rec(field("b", "string", aliases=["a"])), rec(field("a", "int")))
    assert not compat.backward_compatible(rec(field("b", "int")), rec(field("a", "int")))
    with pytest.raises(compat.InvalidAvro):
        compat.backward_compatible({"type": "record", "name": "R"}, rec())


def test_hash_ignores_docs_and_order():
    a = {"type": "record", "name": "R", "doc": "x", "fields": [field("a", "int", doc="y", default=1)]}
    b = {"fields": [{"type": "int", "default": 1, "name": "a"}], "name": "R", "type": "record"}
    assert canonical.schema_hash(a) == canonical.schema_hash(b)
    assert canonical.schema_hash(a) != canonical.schema_hash(rec(field("a", "int", default=2)))


def test_fingerprint_of_null():
    assert canonical.fingerprint("null") == 0x63DD24E7CC258F8A
    assert canonical.fingerprint('"int"') == 0x7275D51A3F395C8F


def test_registry(tmp_path):
    r = Registry(str(tmp_path / "r.json"))
    with pytest.raises(compat.TopicNotFound):
        r.register("t", rec())
    r.create_topic("t")
    first = r.register("t", rec(field("a", "int")))
    assert first == 100 and r.register("t", rec(field("a", "int"))) == 100
    second = r.register("t", rec(field("a", "long")))
    with pytest.raises(compat.Incompatible):
        r.register("t", rec(field("a", "string")))
    assert r.list("t") == [second, first] and r.latest("t")[0] == second
    assert Registry(str(tmp_path / "r.json")).list("t") == [101, 100]
    with pytest.raises(compat.NotFound):
        r.get(5)


def test_evolution_steps():
    steps = evolve.evolution(V2, V1)
    assert [(s.what, s.name) for s in steps] == [("rename", "o_orderstatus"), ("delete", "o_custkey"), ("add", "currency"), ("add", "note")]
    assert evolve.evolution(V1, V1) == []
    assert [(s.what, s.name) for s in evolve.evolution(rec(field("a", ["null", "long"])), rec(field("a", ["null", "int"])))] == [("widen", "a")]
    assert evolve.evolution(rec(field("a", "int")), rec(field("a", "int"), field("b", "int"))) == []


def test_table_columns():
    t = evolve.table_type(rec(field("a", "long"), field("b", {"type": "array", "items": "int"}), field("c", ["null", {"type": "record", "name": "I", "fields": [field("x", "float")]}])))
    ids = {f.name: f.metadata["field_id"] for f in t}
    assert ids == {"a": 1, "b": 2, "c": 4, "_offset": 10000, "_partition_id": 10001, "_ingest_time": 10002, "_key": 10003}
    assert not t["a"].nullable and t["c"].nullable
    assert t["b"].dataType == T.ArrayType(T.IntegerType(), False)
    with pytest.raises(compat.SchemaError):
        evolve.table_type({"type": "array", "items": "int"})


class Color(enum.Enum):
    RED = "red"
    BLUE = "blue"


def test_declared():
    @schema
    class Inner:
        x: int

    @schema(renames={"title": "name"}, deletions=("gone",))
    class Order:
        name: str
        amount: Annotated[int, NonNull] = 3
        small: Annotated[int, Int32] = 0
        rate: Annotated[float, Float32] = 0.0
        note: Optional[str] = None
        tags: list[str] = None
        counts: dict[str, int] = None
        color: Color = None

    avro = Order.avro()
    types = {f["name"]: f["type"] for f in avro["fields"]}
    assert types["name"] == ["null", "string"] and types["amount"] == "long" and types["small"] == ["null", "int"] and types["rate"] == ["null", "float"]
    assert avro["fields"][1]["default"] == 3 and avro["fields"][0]["aliases"] == ["title"]
    assert types["color"][1]["symbols"] == ["red", "blue"]
    assert avro["tidemark.renames"] == {"title": "name"} and avro["tidemark.deletions"] == ["gone"]
    evolve.table_type(avro)
    for bad in (dict[int, str], int | str, object):
        with pytest.raises(compat.SchemaError):

            @schema
            class _Bad:
                f: bad

    with pytest.raises(compat.SchemaError):

        @schema(renames={"a": "missing"})
        class _Renamed:
            f: int
