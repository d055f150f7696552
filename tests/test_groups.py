import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators.groups import Group, MaxInFlight, NotOwner, UnknownMember
from tidemark.operators.materialize import next_epoch

SEGMENTS = [(i * 100, i * 100 + 100, 50) for i in range(40)]


def test_poll_commit_watermark():
    g = Group().join("a", 0).join("b", 0)
    g, x = g.poll("a", 0, SEGMENTS, 100)
    g, y = g.poll("b", 0, SEGMENTS, 60)
    assert (x.start, x.end, y.start, y.end) == (0, 200, 200, 400)
    g = g.commit("b", 200, 400)  # out of order
    assert g.watermark == 0
    g = g.commit("a", 0, 200)
    assert g.watermark == 400 == g.cursor
    for bad in (("a", 0, 200), ("b", 0, 100)):
        with pytest.raises(NotOwner):
            g.commit(*bad)


def test_steal_and_limits():
    g = Group().join("a", 0).join("b", 0)
    g, x = g.poll("a", 0, SEGMENTS, 1)
    g, y = g.poll("b", 100, SEGMENTS, 1)
    assert (y.start, y.end, y.reader) == (x.start, x.end, "b")
    assert g.poll("stranger", 0, SEGMENTS, 1)[1] is None
    for _ in range(9):
        g, _ = g.poll("b", 100, SEGMENTS, 1)
    with pytest.raises(MaxInFlight):
        g.poll("b", 100, SEGMENTS, 1)
    with pytest.raises(UnknownMember):
        g.heartbeat("stranger", 0)


def test_silent_members_are_released():
    g = Group().join("a", 0).join("b", 0)
    g, _ = g.poll("a", 0, SEGMENTS, 1)
    g, _ = g.poll("b", 0, SEGMENTS, 1)
    g = g.heartbeat("b", 31)
    assert set(g.members) == {"b"} and g.cursor == 0 and [x.reader for x in g.leases] == ["b"]
    assert g.watermark == 100
    assert g.force_reset().cursor == 100


def test_removal_rolls_back_by_choice():
    g, _ = Group().join("a", 0).poll("a", 0, SEGMENTS, 1)
    assert g.force_remove("a").cursor == 0
    assert g.force_remove("a", roll_back=False).cursor == 100
    assert g.leave("a").cursor == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["join", "poll", "commit", "leave", "beat"]), st.sampled_from("abc"), st.integers(0, 40)), max_size=60))
def test_nothing_committed_is_lost(events):
    """Whatever happens, the watermark never passes an offset that nobody has committed."""
    g, now, done = Group(), 0.0, set()
    for what, who, wait in events:
        now += wait
        try:
            if what == "join":
                g = g.join(who, now)
            elif what == "poll":
                g, _ = g.poll(who, now, SEGMENTS, 60)
            elif what == "leave":
                g = g.leave(who)
            elif what == "beat":
                g = g.heartbeat(who, now)
            elif mine := [x for x in g.leases if x.reader == who]:
                g = g.commit(who, mine[-1].start, mine[-1].end)
                done |= set(range(mine[-1].start, mine[-1].end))
        except (MaxInFlight, UnknownMember, NotOwner):
            pass
        assert set(range(g.watermark)) <= done


def test_epochs():
    assert next_epoch(None, 0, 0, "a", 5) == 1
    assert next_epoch("a", 3, 10, "a", 5) == 3
    assert next_epoch("b", 3, 10, "a", 5) is None
    assert next_epoch("b", 3, 5, "a", 5) == 4
    assert next_epoch("a", 3, 1, "a", 5) == 4
