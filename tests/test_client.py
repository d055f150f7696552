import pytest

from tidemark.client import Log, StaleAppend, TopicExists, UnknownTopic
from tidemark.schema.compat import Incompatible

SCHEMA = {"type": "record", "name": "R", "fields": [{"name": "a", "type": "int"}]}


def records(spark, values, parts=3):
    return spark.createDataFrame([(None if i % 3 else f"k{i}".encode(), v.encode()) for i, v in enumerate(values)], "key binary, value binary").repartition(parts)


def test_write_and_read(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    log.create_topic("t")
    with pytest.raises(TopicExists):
        log.create_topic("t")
    assert log.read("t").count() == 0 and log.high_watermark("t") == 0 and log.high_watermark("none") == 0
    number = log.register("t", SCHEMA)
    with pytest.raises(Incompatible):
        log.register("t", SCHEMA | {"fields": [{"name": "a", "type": "string"}]})
    a = log.append("t", number, records(spark, [f"v{i}" for i in range(50)]), "w", 1, 0, segment_bytes=40)
    assert (a.start_offset, a.end_offset) == (0, 50)
    again = log.append("t", number, records(spark, ["x"]), "w", 1, 0)
    assert again.duplicate and (again.start_offset, again.end_offset) == (0, 50)
    b = log.append("t", number, records(spark, ["y", "z"]), "w", 2, 0)
    assert (b.start_offset, b.end_offset) == (50, 52)
    with pytest.raises(StaleAppend):
        log.append("t", number, records(spark, ["x"]), "w", 1, 0)
    rows = log.read("t").collect()
    assert sorted(r._offset for r in rows) == list(range(52))
    assert {bytes(r.value).decode() for r in rows} == {*(f"v{i}" for i in range(50)), "y", "z"}
    some = log.read("t", 10, max_bytes=1).collect()
    assert some and min(r._offset for r in some) == 10  # one segment, clipped
    assert [r._offset for r in log.read("t", 50, end=51).collect()] == [50]
    with pytest.raises(UnknownTopic):
        log.read("none")


def test_groups(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    log.create_topic("t")
    log.append("t", 100, records(spark, [f"v{i}" for i in range(40)], 2), "w", 1, 0, segment_bytes=30)
    log.join("g", "t", "r1", 0)
    seen = []
    while got := log.poll("g", "t", "r1", 1, max_bytes=60):
        lease, rows = got
        offsets = sorted(r._offset for r in rows.collect())
        assert offsets == list(range(lease.start, lease.end))
        seen += offsets
        assert log.commit("g", "t", lease) == lease.end
    assert seen == list(range(40))
    log.leave("g", "t", "r1")
    assert log.poll("g", "t", "r1", 2) is None


def test_a_crash_before_the_commit_shows_nothing(spark, tmp_path, monkeypatch):
    log = Log(spark, str(tmp_path / "log"))
    log.create_topic("t")
    with monkeypatch.context() as m:
        m.setattr(log, "_commit", lambda s: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            log.append("t", 100, records(spark, ["a"]), "w", 1, 0)
    assert log.high_watermark("t") == 0 and log.read("t").count() == 0
    assert log.append("t", 100, records(spark, ["a"]), "w", 1, 0).end_offset == 1


def test_a_new_topic_has_nothing_of_a_deleted_one(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    log.create_topic("a")
    log.append("a", 100, spark.createDataFrame([(None, bytearray(b"x")), (None, bytearray(b"y"))], "key binary, value binary"), "w", 1, 0)
    log.join("g", "a", "r", 0.0)
    log.delete_topic("a")
    assert log.create_topic("b") == 2 and log.high_watermark("b") == 0
    assert log.read("b").count() == 0
    assert log.create_topic("a") == 3 and not log.state()["groups"]


def test_a_read_ends_at_its_budget_only(spark, tmp_path):
    """Over 256 segments, which one scan of a broker has at most."""
    log = Log(spark, str(tmp_path / "log"))
    log.create_topic("t")
    log.append("t", 100, records(spark, [f"{i:03}" for i in range(400)], 1), "w", 1, 0, segment_bytes=1)
    assert log.index().count() == 400
    assert sorted(r._offset for r in log.read("t", 20).collect()) == list(range(20, 400))
    assert log.read("t", 20, max_bytes=1 << 20).count() == 380 and log.read("t", 20, end=390).count() == 370
    size = {r.start_offset: r.byte_length for r in log.index().collect()}
    budget = sum(size[i] for i in range(300))
    assert sorted(r._offset for r in log.read("t", max_bytes=budget).collect()) == list(range(300))
