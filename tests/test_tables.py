import pytest

from tidemark.operators import verify
from tidemark.sources.tables import Conflict, Fenced, LogTable


def batch(spark, rows):
    return spark.createDataFrame(rows, "topic string, batch_id bigint, v bigint")


def test_replay_adds_nothing(spark, tmp_path):
    t = LogTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    one = batch(spark, [("a", 1, i) for i in range(100)])
    assert t.append(one, 1) == 100
    assert t.append(one, 1) == 0
    assert t.append(one.unionByName(batch(spark, [("a", 2, i) for i in range(50)])), 1) == 50
    assert t.read().count() == 150


def test_late_batch_is_taken(spark, tmp_path):
    t = LogTable(spark, str(tmp_path / "t"))
    t.append(batch(spark, [("a", 2, 0)]), 1)
    assert t.append(batch(spark, [("a", 1, 0)]), 1) == 1


def test_fencing_and_conflicts(spark, tmp_path):
    t = LogTable(spark, str(tmp_path / "t"))
    t.append(batch(spark, [("a", 1, 0)]), 2)
    with pytest.raises(Fenced):
        t.append(batch(spark, [("a", 2, 0)]), 1)
    with pytest.raises(Conflict):
        t._publish({"number": 1, "epoch": 2, "folder": None, "rows": 0, "done": {}})
    assert len(t.commits()) == 1


def test_crash_before_publishing_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    t = LogTable(spark, str(tmp_path / "t"))
    t.append(batch(spark, [("a", 1, 0)]), 1)
    with monkeypatch.context() as m:
        m.setattr(t, "_publish", lambda c: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            t.append(batch(spark, [("a", 2, 0)]), 1)
    assert t.read().count() == 1
    assert t.append(batch(spark, [("a", 2, 0)]), 1) == 1


def test_clean_history_has_no_violation(spark):
    w = spark.createDataFrame([("w", "t", i, i * 10, 2 * i, 2 * i + 1, True) for i in range(20)], "writer_id string, topic string, offset bigint, value bigint, start_time bigint, end_time bigint, success boolean")
    r = spark.createDataFrame([("t", "r", s, s * 5, [i * 10 for i in range(s * 5, s * 5 + 5)], s * 5 + 5) for s in range(4)], "topic string, reader_id string, seq bigint, requested_offset bigint, values array<bigint>, high_watermark bigint")
    for found in (verify.lost_writes(w, r), verify.shared_offsets(w), verify.falling_watermarks(r), verify.duplicate_values(r), verify.poll_gaps(r), verify.causal_violations(w), verify.unordered_sends(w), verify.phantoms(w, r)):
        assert found.count() == 0
    assert verify.lost_writes(w, r.filter("seq < 3")).count() == 5
