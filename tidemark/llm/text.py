"""Array-at-a-time text primitives shared by the training-data operators.

Arrow hands a Python worker many documents as one byte buffer plus offsets. The helpers here work on
that buffer as a whole (word boundaries, word hashes, line hashes), so a document costs no Python-level
loop. All of them accept nulls, which count as empty texts.
"""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepared

#: Documents are worked on in slices of about this many text bytes; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows in an Arrow batch that goes to a Python worker.
BATCH_ROWS = 512

_SEED = np.random.default_rng(20240607)
#: A random 64-bit number for each byte value.
BYTE_CODE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Base of the rolling hash and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Words are runs of bytes other than these: space and \x09-\x0D.
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The printable character that stands for each byte in byte-level vocabularies.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_others = iter(range(256, 512))
BYTE_CHARS = [chr(b) if b in _PRINTED else chr(next(_others)) for b in range(256)]
_BYTE_MAP = dict(enumerate(BYTE_CHARS))


def byte_level(text: str) -> str:
    """A text in the characters of byte-level vocabularies."""
    return text.encode().decode("latin-1").translate(_BYTE_MAP)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """Some documents: bytes in one array, document i at offsets[i]:offsets[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._sums: np.ndarray | None = None

    def prefix(self, codes: np.ndarray = BYTE_CODE) -> np.ndarray:
        up, _ = powers(len(self.data) + 1)
        out = np.empty(len(self.data) + 1, dtype=np.uint64)
        out[0] = 0
        np.cumsum(codes[self.data] * up[: len(self.data)], out=out[1:], dtype=np.uint64)
        return out

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each data[start:end]; equal bytes give equal hashes."""
        if self._sums is None:
            self._sums = self.prefix()
        _, down = powers(len(self.data) + 1)
        x = self._sums.take(ends, mode="clip")
        x -= self._sums.take(starts, mode="clip")
        x *= down.take(starts, mode="clip")
        return mix(x + (ends - starts).astype(np.uint64))

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of True bytes, cut at document borders."""
        n = len(inside)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        before = np.empty(n, dtype=bool)
        before[0] = False
        before[1:] = inside[:-1]
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = inside[1:]
        return np.flatnonzero(inside & (~before | cut[:-1])), np.flatnonzero(inside & (~after | cut[1:])) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and words per document before document i (n + 1 values)."""
        starts, ends = self.runs(IS_WORD[self.data])
        return starts, ends, np.searchsorted(starts, self.offsets)


def texts_of(column: pa.Array, lower: bool = False) -> Texts:
    """The bytes of a string column; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return Texts(LOWER[raw] if lower else raw, offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece has about `limit` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    lengths = batch.column(column).fill_null("").cast(pa.large_string())
    off = np.frombuffer(lengths.buffers()[1], dtype=np.int64, count=n + 1 + lengths.offset)[lengths.offset :]
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, min(end, n) - at)
        at = min(end, n)


def give_back() -> None:
    """Gives memory that this worker has freed back to the machine, and lets Arrow take its own where numpy does, so that
    what one frees the other can take."""
    pa.set_memory_pool(pa.system_memory_pool())
    if len(_powers.get("up", ())) > 2 * SLICE_BYTES:
        _powers.clear()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, in a worker that gives memory back before and after. Workers are used again by all stages of
    a session, and would else hold what the largest of their tasks took."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what a task holds besides, as a model, is only freed after it
        yield from run(batches)
        give_back()

    return tidy


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow of `fn` over slices of documents; memory is bounded by a slice, not by a partition."""
    prepared(df.sparkSession).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                if (out := fn(part)) is not None:
                    yield out

    return df.mapInArrow(tidied(run), schema)


def held_out(doc_id: Column, parts: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == remainder, F.lit(False))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows of df (all, if there are no more): those whose key's hash is below a cut.

    A cut by count needs no sort, and no task sends the driver more than its share; twice `rows` is the bound.
    """
    n = df.count()
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(2**31)) < int(rows / n * 2**31)).limit(2 * rows)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Tables of one run, written to the folder that driver and executors share.

    The folder is the session's spark.checkpoint.dir. Only in a local session where that is unset, as in tests,
    a folder below the working directory's warehouse is used; a cluster without it is refused, as executors
    would write to folders of their own. A written table cuts lineage: when an executor is lost, only tasks of
    the running stage are done again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
        self.names: list[str] = []
        self.path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        self.names.append(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_parts(self, df: DataFrame, name: str, column: str, values: list[str]) -> list[DataFrame]:
        """Writes a table once, in a folder for each of a column's values, and gives the tables without it."""
        path = f"{self.path}/{name}"
        self.names.append(name)
        df.write.partitionBy(column).option("compression", "zstd").parquet(path)
        rest = df.drop(column)
        there = self.spark.read.schema(df.schema).parquet(path)  # no row may have a value
        found = {r[0] for r in there.select(column).distinct().collect()}
        return [self.spark.read.schema(rest.schema).parquet(f"{path}/{column}={v}") if v in found else self.spark.createDataFrame([], rest.schema) for v in values]

    def finish(self, df: DataFrame) -> DataFrame:
        """Writes a run's result and removes all its other tables."""
        others = list(self.names)
        out = self.write(df, "result")
        del df
        self.drop(*others)
        return out

    def forget(self) -> None:
        """Lets Spark remove the shuffle files of plans that nothing refers to any more, now and not some time later.

        A session holds on to its last plan, so a small one takes that place first.
        """
        self.spark.range(1).collect()
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more, and lets Spark forget shuffles that are done."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names or ("",):
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            p.getFileSystem(conf).delete(p, True)
        self.forget()
