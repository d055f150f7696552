"""Reader groups: leases on offset ranges.

`Group` is the state machine of one group and topic, a pure value that the driver keeps and stores; time is
always passed in. The functions after it are the same rules for all groups at once, over tables of leases,
members and cursors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the protocol, in seconds and ranges.
LEASE_S, SESSION_S, MAX_IN_FLIGHT = 45, 30, 10


class GroupError(Exception):
    pass


class UnknownMember(GroupError):
    pass


class NotOwner(GroupError):
    pass


class MaxInFlight(GroupError):
    pass


@dataclass(frozen=True)
class Lease:
    start: int
    end: int
    reader: str
    expires: float


@dataclass(frozen=True)
class Group:
    cursor: int = 0
    watermark: int = 0
    members: dict[str, float] = field(default_factory=dict)
    leases: tuple[Lease, ...] = ()

    def join(self, reader: str, now: float) -> Group:
        return replace(self, members=self.members | {reader: now})

    def heartbeat(self, reader: str, now: float) -> Group:
        """Renews the reader and its leases, and drops members that have been silent too long."""
        if reader not in self.members:
            raise UnknownMember(reader)
        members = self.members | {reader: now}
        gone = {m for m, seen in members.items() if seen < now - SESSION_S}
        renewed = tuple(replace(x, expires=now + LEASE_S) if x.reader == reader else x for x in self.leases)
        g = replace(self, members={m: s for m, s in members.items() if m not in gone}, leases=renewed)
        return g._release(lambda x: x.reader in gone, roll_back=True)

    def poll(self, reader: str, now: float, segments: list[tuple[int, int, int]], max_bytes: int, rows: int = 10) -> tuple[Group, Lease | None]:
        """A range for the reader: an expired lease if there is one, else what follows the cursor.

        segments: (start, end, bytes) in offset order.
        """
        if reader not in self.members:
            return self, None
        if sum(x.reader == reader for x in self.leases) >= MAX_IN_FLIGHT:
            raise MaxInFlight(reader)
        expired = min((x for x in self.leases if x.expires < now), key=lambda x: x.start, default=None)
        if expired:
            mine = replace(expired, reader=reader, expires=now + LEASE_S)
            return replace(self, leases=tuple(mine if x is expired else x for x in self.leases)), mine
        end, held = self.cursor, 0
        for _, e, size in [s for s in segments if s[1] > self.cursor][:rows]:
            end, held = e, held + size
            if held >= max_bytes:
                break
        if end == self.cursor:
            return self, None
        mine = Lease(self.cursor, end, reader, now + LEASE_S)
        return replace(self, cursor=end, leases=(*self.leases, mine)), mine

    def commit(self, reader: str, start: int, end: int) -> Group:
        """Ends a lease, in any order; the range must be the leased one exactly."""
        if not any((x.reader, x.start, x.end) == (reader, start, end) for x in self.leases):
            raise NotOwner(reader, start, end)
        return self._release(lambda x: (x.reader, x.start) == (reader, start), roll_back=False)

    def leave(self, reader: str) -> Group:
        g = replace(self, members={m: s for m, s in self.members.items() if m != reader})
        return g._release(lambda x: x.reader == reader, roll_back=True)

    def force_reset(self) -> Group:
        """Starts over from what is committed."""
        return Group(self.watermark, self.watermark)

    def force_remove(self, reader: str, roll_back: bool = True) -> Group:
        """Removes a member. Without roll_back its ranges are never handed out again."""
        g = replace(self, members={m: s for m, s in self.members.items() if m != reader})
        return g._release(lambda x: x.reader == reader, roll_back)

    def _release(self, which: Callable[[Lease], bool], roll_back: bool) -> Group:
        out = [x for x in self.leases if which(x)]
        left = tuple(x for x in self.leases if not which(x))
        cursor = min([self.cursor, *(x.start for x in out)]) if roll_back else self.cursor
        return replace(self, cursor=cursor, leases=left, watermark=min((x.start for x in left), default=cursor))


def committed_watermark(cursors: DataFrame, leases: DataFrame, key: str = "topic") -> DataFrame:
    """The smallest start still leased, or else the cursor."""
    low = leases.groupBy(key).agg(F.min("start_offset").alias("_low"))
    return cursors.join(low, key, "left").select(key, F.coalesce("_low", "cursor").alias("watermark"))


def roll_back(cursors: DataFrame, released: DataFrame, key: str = "topic") -> DataFrame:
    """The cursor after leases were given back: never past the first of them."""
    low = released.groupBy(key).agg(F.min("start_offset").alias("_low"))
    return cursors.join(low, key, "left").select(key, F.least("cursor", F.coalesce("_low", "cursor")).alias("cursor"))


def expired_members(members: DataFrame, now: Column, seconds: int = SESSION_S) -> DataFrame:
    return members.filter(F.col("last_heartbeat") < now - F.expr(f"INTERVAL {seconds} SECONDS"))


def steal(leases: DataFrame, now: Column, key: str = "topic") -> DataFrame:
    """Each group's expired lease with the smallest start."""
    old = leases.filter(F.col("lease_expires_at") < now)
    first = F.min_by(F.struct("start_offset", "end_offset", "reader_id"), "start_offset").alias("s")
    return old.groupBy(key).agg(first).select(key, "s.*")


def may_poll(members: DataFrame, leases: DataFrame, limit: int = MAX_IN_FLIGHT, key: str = "topic") -> DataFrame:
    """Members with their leases in flight, and whether they may have another."""
    n = leases.groupBy(key, "reader_id").agg(F.count("*").alias("_n"))
    held = F.coalesce("_n", F.lit(0))
    return members.join(n, [key, "reader_id"], "left").select(key, "reader_id", held.alias("in_flight"), (held < limit).alias("may_poll"))


def dispatch(index: DataFrame, cursors: DataFrame, max_bytes: int, rows: int = 10, key: str = "topic") -> DataFrame:
    """The range that each group's next poll leases: from the cursor, which may lie inside a segment."""
    ahead = index.join(cursors.select(key, "cursor"), key).filter(F.col("end_offset") > F.col("cursor"))
    w = Window.partitionBy(key).orderBy("start_offset")
    ahead = ahead.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.coalesce(F.sum("byte_length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ahead.filter((F.col("_n") <= rows) & (F.col("_before") < max_bytes)).groupBy(key).agg(F.first("cursor").alias("start_offset"), F.max("end_offset").alias("end_offset"))


def reset(cursors: DataFrame, watermarks: DataFrame, key: str = "topic") -> DataFrame:
    return cursors.select(key).join(watermarks, key).select(key, F.col("watermark").alias("cursor"), "watermark")


def summaries(groups: DataFrame, members: DataFrame, key: str = "topic") -> DataFrame:
    """Groups with their number of members (0 if none)."""
    n = members.groupBy(key).agg(F.count("*").alias("_n"))
    return groups.join(n, key, "left").select(*groups.columns, F.coalesce("_n", F.lit(0)).alias("members"))
