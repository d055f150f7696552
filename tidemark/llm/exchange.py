"""How blocks of texts ask ranges of keys, and are answered.

A block of some MB of text is one row, and what it asks one range of hashed keys is another, packed: sorted keys
as differences, numbers as planes of bytes, compressed. That is a small part of the rows that its words would be.
Rows number blocks times ranges, like the pieces of Spark's own shuffles. A task holds the questions of one range
at a time, and the number of ranges grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from .text import slices, tidied

BLOCK_BYTES = 4 << 20
RANGE_BYTES = 8 << 20  # text for each range


def ranges_for(size: int) -> int:
    """The number of ranges, a power of two, for so many bytes of text."""
    return max(64, 1 << (size // RANGE_BYTES).bit_length())


def ragged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start to start + size of each row, one after another, and where each row's begin (n + 1)."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return np.arange(ends[-1]) + np.repeat(start - ends[:-1], size), ends


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order of first occurrence, and each value's number."""
    d = pc.dictionary_encode(pa.array(x))
    return d.dictionary.to_numpy(), d.indices.to_numpy()


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order of first occurrence, where each occurs first, and each value's number."""
    values, number = codes(x)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1)) if len(x) else np.empty(0, np.int64)
    return values, first, number


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers: how many, then all their lowest bytes, and so on up."""
    if x.dtype == np.uint8:
        return np.array([len(x), 1], "<u8").tobytes() + x.tobytes()
    x = np.ascontiguousarray(x.astype("<u8"))
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return np.array([len(x), width], "<u8").tobytes() + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(map(_planes, columns)))


def unpack(data: bytes) -> list[np.ndarray]:
    """The columns: those of one byte as bytes, the others as 64-bit numbers."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n, width = np.frombuffer(raw, "<u8", count=2, offset=at).tolist()
        planes = np.frombuffer(raw, np.uint8, count=n * width, offset=at + 16)
        at += 16 + n * width
        if width > 1:
            x = np.zeros((n, 8), dtype=np.uint8)
            x[:, :width] = planes.reshape(width, n).T
            planes = x.view("<u8").ravel()
        out.append(planes)
    return out


#: Numbers whose bits are spread out at a time; eight of them fill whole bytes.
_SKEWED_ROWS = 1 << 16


def skewed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of which small ones are frequent, as two columns of bytes: each one's bits are counted, and kept
    but for the first, those of equal length together."""
    v = x.astype(np.int64) + 1
    size = np.frexp(v.astype(np.float64))[1].astype(np.uint8)
    bits = [np.empty(0, np.uint8)]
    for k in range(2, int(size.max()) + 1 if len(v) else 0):
        low = v[size == k]
        for i in range(0, len(low), _SKEWED_ROWS):
            bits.append(np.packbits((low[i : i + _SKEWED_ROWS, None] >> np.arange(k - 1)).astype(np.uint8) & 1))
    return size, np.concatenate(bits)


def unskewed(size: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The numbers that `skewed` made two columns of."""
    out, at = np.ones(len(size), dtype=np.int64), 0
    many = np.bincount(size, minlength=2)
    for k in range(2, len(many)):
        n = int(many[k]) * (k - 1)
        here = np.unpackbits(bits[at : at + -(-n // 8)], count=n).reshape(-1, k - 1)
        low = np.full(len(here), 1 << (k - 1), dtype=np.int64)
        for b in range(k - 1):
            low |= here[:, b].astype(np.int64) << b
        out[size == k] = low
        at += -(-n // 8)
    return out - 1


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first)


def batch_of(schema: str, *columns: list) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


ASKED = "who bigint, idx int, data binary"


def by_range(asked: DataFrame, answer: Callable[[int, list[tuple[int, bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Questions (who, idx, data) brought to their ranges; a task holds one range's at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        now = None
        for b in batches:
            for who, i, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if i != now and held:
                    yield from answer(now, held)
                    held = []
                now = i
                held.append((who, data))
        if held:
            yield from answer(now, held)

    return asked.repartition("idx").sortWithinPartitions("idx", "who").mapInArrow(tidied(run), schema)


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches with about `limit` bytes of text, one text at least."""
    kept, size = [], 0
    for batch in batches:
        for b in slices(batch, "text", limit // 4):
            kept.append(b)
            size += b.nbytes
            if size >= limit:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, size = [], 0
    if size or kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()[:1]
