"""A table of the log: Parquet files, and commits that say which of them count.

A batch of segments is written below its own folder, and becomes visible by one rename of a commit file
that names it. Commits hold the watermark of each topic, so that a batch that comes again adds nothing, and
the committer's epoch, so that a holder whose lease has passed on can't commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Fenced(Exception):
    """A committer with a higher epoch has been here."""


class Conflict(Exception):
    """Another commit took this number first; read again and retry."""


class LogTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """All commits, oldest first."""
        folder = self._fs_path(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder))
        return [json.loads(self._text(f"{self.path}/_commits/{n}")) for n in names if n.endswith(".json")]

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._fs_path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def state(self) -> dict:
        """Watermarks and exceptions by topic, epoch and number of the last commit."""
        all_ = self.commits()
        return all_[-1] if all_ else {"number": 0, "epoch": 0, "done": {}, "folder": None}

    def append(self, rows: DataFrame, epoch: int, topic: str = "topic", batch: str = "batch_id") -> int:
        """Commits the rows of batches that aren't in the table yet; returns how many rows that were.

        Batches are remembered one by one until they close a run, so an older batch that comes late is still
        taken, and one that comes twice isn't.
        """
        s = self.state()
        if epoch < s["epoch"]:
            raise Fenced(f"epoch {epoch} after {s['epoch']}")
        done = {t: set(b) for t, b in s["done"].items()}
        asked = [(r[topic], r[batch]) for r in rows.select(topic, batch).distinct().collect()]  # one a segment
        new = [(t, b) for t, b in asked if b not in done.get(t, set())]
        folder, n = None, 0
        if new:
            folder = f"data/{uuid.uuid4().hex}"
            keys = self.spark.createDataFrame(new, rows.select(topic, batch).schema)
            fresh = rows.join(keys, [topic, batch], "left_semi")
            fresh.sortWithinPartitions(topic, batch).write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
            n = self.spark.read.parquet(f"{self.path}/{folder}").count()
        for t, b in new:
            done.setdefault(t, set()).add(b)
        self._publish({"number": s["number"] + 1, "epoch": epoch, "folder": folder, "rows": n, "done": {t: sorted(b) for t, b in done.items()}})
        return n

    def _publish(self, commit: dict) -> None:
        name = f"{self.path}/_commits/{commit['number']:010d}.json"
        part = f"{self.path}/_commits/.{uuid.uuid4().hex}"
        self._fs.mkdirs(self._fs_path(f"{self.path}/_commits"))
        out = self._fs.create(self._fs_path(part))
        out.write(json.dumps(commit).encode())
        out.close()
        if self._fs.exists(self._fs_path(name)) or not self._fs.rename(self._fs_path(part), self._fs_path(name)):
            self._fs.delete(self._fs_path(part), False)
            raise Conflict(name)

    def read(self) -> DataFrame | None:
        folders = [f"{self.path}/{c['folder']}" for c in self.commits() if c["folder"]]
        return self.spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet as the log's sinks write it: zstd, dictionaries, pages of 1 MiB."""
    df.write.option("compression", "zstd").option("parquet.page.size", 1 << 20).option("parquet.enable.dictionary", "true").partitionBy(*partition_by).parquet(path)


def by_day(df: DataFrame, time: str = "ingest_time") -> DataFrame:
    """Adds the day that tables are partitioned by."""
    return df.withColumn("day", F.to_date(time))
