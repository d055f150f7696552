"""The log as an object: topics, schemas, appends, reads and reader groups over one folder.

The folder may lie in any store that Hadoop's file systems reach. Executors encode segments and write them with
Spark's committer; one commit file then makes them visible, with the offsets they got and the writers' numbers.
A commit file exists or it doesn't, so a crash before it leaves files that nobody reads, and nothing else.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec
from .operators import append as appending
from .operators import scan
from .operators.groups import Group, Lease
from .schema.registry import Registry
from .session import prepared
from .sources.segments import read_segments
from .sources.tables import Conflict

_STORED = "part int, seg int, record_count bigint, byte_length bigint, crc32 bigint, payload binary"
_INDEX = ["topic_id", "schema_id", "start_offset", "end_offset", "record_count", "byte_length", "crc32", "ingest_ms", "part", "seg", "folder"]


class StaleAppend(Exception):
    """The writer has appended a higher number already."""


class UnknownTopic(Exception):
    pass


class TopicExists(Exception):
    pass


@dataclass(frozen=True)
class Ack:
    """The offsets of an append: start_offset up to, but not with, end_offset."""

    topic_id: int
    schema_id: int
    start_offset: int
    end_offset: int
    duplicate: bool = False


class Log:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = prepared(spark), path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- state

    def state(self) -> dict:
        """What the last commit says."""
        folder = self._path(f"{self.path}/_commits")
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return {"number": 0, "last_topic_id": 0, "topics": {}, "writers": {}, "schemas": {}, "links": {}, "folders": [], "groups": {}}
        stream = self._fs.open(self._path(f"{self.path}/_commits/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        """Publishes the state under the next number, by rename."""
        state = state | {"number": state["number"] + 1}
        name, part = f"{self.path}/_commits/{state['number']:012d}.json", f"{self.path}/_commits/.{uuid.uuid4().hex}"
        self._fs.mkdirs(self._path(f"{self.path}/_commits"))
        out = self._fs.create(self._path(part))
        out.write(json.dumps(state).encode())
        out.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(self._path(part), self._path(name)):
            self._fs.delete(self._path(part), False)
            raise Conflict(name)

    def _topic(self, state: dict, topic: str | int) -> tuple[str, dict]:
        """A topic by name or number."""
        for name, t in state["topics"].items():
            if topic == name or str(topic) == str(t["topic_id"]):
                return name, t
        raise UnknownTopic(topic)

    # -- topics and schemas

    def create_topic(self, name: str, retention_hours: int = 168) -> int:
        s = self.state()
        if name in s["topics"]:
            raise TopicExists(name)
        # never a number that a topic had before: its records are still in the index
        number = 1 + max([s.get("last_topic_id", 0), *(t["topic_id"] for t in s["topics"].values())])
        s["last_topic_id"] = number
        s["topics"][name] = {"topic_id": number, "retention_hours": retention_hours, "next_offset": 0}
        s["links"][name] = []
        self._commit(s)
        return number

    def delete_topic(self, topic: str) -> None:
        s = self.state()
        name, t = self._topic(s, topic)
        del s["topics"][name]
        s["last_topic_id"] = max(s.get("last_topic_id", 0), t["topic_id"])
        s["links"].pop(name, None)
        s["groups"] = {k: g for k, g in s["groups"].items() if k.rpartition("/")[2] != name}
        self._commit(s)

    def topics(self) -> list[str]:
        """Newest first."""
        return sorted((t := self.state()["topics"]), key=lambda n: -t[n]["topic_id"])

    def register(self, topic: str, schema: dict) -> int:
        s = self.state()
        r = Registry(schemas={int(k): v for k, v in s["schemas"].items()}, links=s["links"])
        number = r.register(topic, schema)
        self._commit(s | {"schemas": r.schemas, "links": r.links})
        return number

    # -- writing

    def append(self, topic: str, schema_id: int, records: DataFrame, writer_id: str, append_seq: int, now_ms: int, segment_bytes: int = appending.SEGMENT_MAX_BYTES) -> Ack:
        """Appends records (key, value) in the order of their partitions. The same number again gives the same ack."""
        s = self.state()
        name, t = self._topic(s, topic)
        last = s["writers"].get(writer_id)
        if last and append_seq == last["seq"]:
            return Ack(**last["ack"] | {"duplicate": True})
        if last and append_seq < last["seq"]:
            raise StaleAppend(f"{append_seq} after {last['seq']}")
        folder = uuid.uuid4().hex
        data = f"{self.path}/segments/{folder}"
        self._encode(records, segment_bytes).write.option("compression", "uncompressed").parquet(data)
        made = self.spark.read.parquet(data).drop("payload").withColumn("topic_id", F.lit(t["topic_id"])).withColumn("schema_id", F.lit(schema_id))
        base = self.spark.createDataFrame([(t["topic_id"], t["next_offset"])], "topic_id int, next_offset bigint")
        index = appending.allocate(made, ["part", "seg"], "topic_id", base).withColumn("ingest_ms", F.lit(now_ms).cast("bigint")).withColumn("folder", F.lit(folder))
        index.select(*_INDEX).write.parquet(f"{self.path}/index/{folder}")
        n = self.spark.read.parquet(f"{self.path}/index/{folder}").agg(F.coalesce(F.sum("record_count"), F.lit(0))).first()[0]
        ack = Ack(t["topic_id"], schema_id, t["next_offset"], t["next_offset"] + n)
        s["topics"][name] = t | {"next_offset": ack.end_offset}
        s["writers"][writer_id] = {"seq": append_seq, "ack": asdict(ack)}
        s["folders"].append(folder)
        self._commit(s)
        return ack

    def _encode(self, records: DataFrame, limit: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, held, size, seg = TaskContext.get().partitionId(), [], 0, 0

            def segment() -> pa.RecordBatch:
                payload, crc = codec.encode_segment(held)
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int32()), (seg, pa.int32()), (len(held), pa.int64()), (len(payload), pa.int64()), (crc, pa.int64()), (payload, pa.binary()))], [c.split()[0] for c in _STORED.split(", ")])

            for b in batches:
                for key, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    n = len(key or b"") + len(value)
                    if held and size + n > limit:
                        yield segment()
                        held, size, seg = [], 0, seg + 1
                    held.append((key, value))
                    size += n
            if held:
                yield segment()

        return records.select("key", "value").mapInArrow(run, _STORED)

    # -- reading

    def index(self) -> DataFrame | None:
        """The segments of all commits; None before the first append."""
        folders = self.state()["folders"]
        return self.spark.read.parquet(*[f"{self.path}/index/{f}" for f in folders]) if folders else None

    def high_watermark(self, topic: str) -> int:
        """The next offset; 0 for a topic that doesn't exist."""
        try:
            return self._topic(self.state(), topic)[1]["next_offset"]
        except UnknownTopic:
            return 0

    def read(self, topic: str, offset: int = 0, max_bytes: int | None = None, end: int | None = None) -> DataFrame:
        """Records from `offset` on, all of them, or within a budget of compressed bytes: the segment that crosses it
        is included. Only the budget ends a read, however many segments there are."""
        _, t = self._topic(self.state(), topic)
        index = self.index()
        if index is None:
            return self.spark.createDataFrame([], "topic_id int, schema_id int, _offset bigint, key binary, value binary")
        mine = index.filter(F.col("topic_id") == t["topic_id"])
        chosen = mine.filter(scan.overlaps(offset, end)) if max_bytes is None else scan.budget_scan(mine, offset, max_bytes, end, rows=None, topic="topic_id")
        folders = [f"{self.path}/segments/{r.folder}" for r in chosen.select("folder").distinct().collect()]
        if not folders:
            return self.read_nothing()
        stored = self.spark.read.parquet(*folders).select("part", "seg", "payload", F.element_at(F.split(F.input_file_name(), "/"), -2).alias("folder"))
        return read_segments(stored.join(chosen, ["folder", "part", "seg"]), offset, end)

    def read_nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "topic_id int, schema_id int, _offset bigint, key binary, value binary")

    # -- reader groups

    def _group(self, s: dict, group: str, topic: str) -> Group:
        g = s["groups"].get(f"{group}/{topic}")
        return Group(g["cursor"], g["watermark"], g["members"], tuple(Lease(**x) for x in g["leases"])) if g else Group()

    def _save(self, s: dict, group: str, topic: str, g: Group) -> None:
        s["groups"][f"{group}/{topic}"] = asdict(g)
        self._commit(s)

    def join(self, group: str, topic: str, reader: str, now: float) -> None:
        s = self.state()
        self._save(s, group, topic, self._group(s, group, topic).join(reader, now))

    def heartbeat(self, group: str, topic: str, reader: str, now: float) -> None:
        s = self.state()
        self._save(s, group, topic, self._group(s, group, topic).heartbeat(reader, now))

    def poll(self, group: str, topic: str, reader: str, now: float, max_bytes: int = 1 << 30) -> tuple[Lease, DataFrame] | None:
        """A lease and its records, all of them; None if there is nothing to do."""
        s = self.state()
        name, t = self._topic(s, topic)
        g = self._group(s, group, name)
        index = self.index()
        ahead = []
        if index is not None:  # as few rows as a poll may take
            rows = index.filter((F.col("topic_id") == t["topic_id"]) & (F.col("end_offset") > g.cursor)).orderBy("start_offset").limit(scan.POLL_ROWS)
            ahead = [(r.start_offset, r.end_offset, r.byte_length) for r in rows.collect()]
        g, lease = g.poll(reader, now, ahead, max_bytes)
        if lease is None:
            return None
        self._save(s, group, name, g)
        return lease, self.read(name, lease.start, end=lease.end)

    def commit(self, group: str, topic: str, lease: Lease) -> int:
        """Ends a lease; returns the group's watermark."""
        s = self.state()
        g = self._group(s, group, topic).commit(lease.reader, lease.start, lease.end)
        self._save(s, group, topic, g)
        return g.watermark

    def leave(self, group: str, topic: str, reader: str) -> None:
        s = self.state()
        self._save(s, group, topic, self._group(s, group, topic).leave(reader))
