"""Exact substring deduplication with an enhanced suffix array and its common-prefix interval tree.

A byte goes when it lies in a string of WIDTH bytes that also starts anywhere else in the corpus.

A suffix array of a whole corpus doesn't fit a task, so suffixes are dealt out in such a way that suffixes
with a common prefix of WIDTH bytes meet:

1. The anchor of a WIDTH-byte string is its GRAM-byte part with the smallest hash, the leftmost of equal
   ones. Equal strings have equal anchors at equal places. Neighbouring starts with the same anchor form a
   unit: their bytes, `n` starts long plus WIDTH - 1. About one unit for each 80 bytes of text.
2. Counts by anchor. Anchors that occur once end here: no string of theirs is repeated.
3. An anchor whose units are all the same bytes is one leaf of the interval tree with several occurrences:
   whole units go. Nothing has to be sorted for it.
4. The distinct units of all other anchors are cut out of one document each, and dealt out by anchor. A task
   sorts the starts by prefix doubling, takes the common prefixes of neighbours, and scans them with a stack.
   Each interval of WIDTH or more is tested for left-extension diversity: if all occurrences are preceded by
   the same byte, a longer repeat holds them all. The others are the maximal repeats; each comes with all its
   occurrences.
5. An anchor with more than GROUP_LIMIT distinct units (a short common line in very many documents) would be
   too much for one task. Its starts are dealt out by their whole WIDTH-byte prefix instead; equal prefixes
   are counted before they are shuffled.

Hashes of anchors, units and prefixes have 64 bits and are always used in pairs (anchor and unit).

A null text is empty. Rows are documents: repeated rows count as copies of each other. Nothing is cut across
documents. Other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepared
from .text import Scratch, Texts, fresh, map_slices, texts_of, tidied

WIDTH = 200
GRAM = 40
#: Units of one anchor that a task sorts together: some 2 MB, at about 100 bytes of memory for each.
GROUP_LIMIT = 6_000
#: Bytes of units that a task sorts at a time; a group isn't cut.
SORT_BYTES = 1 << 20
_REACH = WIDTH - GRAM + 1
_PLACE = np.uint64((1 << 24) - 1)
_BLOCK = 1 << 23


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i + w]) for each i up to len(x) - w: minima from both ends of blocks of w."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def units(t: Texts) -> dict[str, np.ndarray]:
    """Anchor hash, unit hash, document, first start and number of starts, in text order; c: repetitions.

    Neighbouring equal units (a run of one character) are one row with their number in c; n is of each of them.
    """
    parts = [_units(t, s, min(s + _BLOCK, len(t.data))) for s in range(0, max(len(t.data), 1), _BLOCK)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _units(t: Texts, begin: int, end: int) -> dict[str, np.ndarray]:
    """Of the starts from begin to end."""
    names = ("ah", "uh", "doc", "lo", "n", "c")
    stop = min(end + WIDTH - 1, len(t.data))
    if stop - begin < WIDTH:
        return {k: np.empty(0, np.uint64 if k in ("ah", "uh") else np.int64) for k in names}
    at = np.arange(begin, stop - GRAM + 1)
    gram = t.span_hash(at, at + GRAM)
    low = sliding_minimum((gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64), _REACH)
    first, last = np.searchsorted(t.offsets, begin, side="right") - 1, np.searchsorted(t.offsets, stop)
    inside = np.zeros(len(low) + 1, dtype=np.int8)
    for_docs = np.arange(first, last)
    a = np.clip(t.offsets[for_docs] - begin, 0, len(low))
    b = np.clip(t.offsets[for_docs + 1] - WIDTH + 1 - begin, 0, len(low))
    ok = b > a
    np.add.at(inside, a[ok], 1)
    np.add.at(inside, b[ok], -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(starts):
        return {k: np.empty(0, np.uint64 if k in ("ah", "uh") else np.int64) for k in names}
    anchor = (low[starts] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    lo = starts[new]
    hi = starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])]
    ah, uh = gram[anchor[new]], t.span_hash(lo + begin, hi + begin + WIDTH)
    same = np.concatenate([[False], (ah[1:] == ah[:-1]) & (uh[1:] == uh[:-1]) & (lo[1:] == hi[:-1] + 1)])
    head = np.flatnonzero(~same)
    c = np.diff(np.concatenate([head, [len(lo)]]))
    doc = t.doc_of(lo[head] + begin)
    return {"ah": ah[head], "uh": uh[head], "doc": doc, "lo": lo[head] + begin - t.offsets[doc], "n": hi[head] - lo[head] + 1, "c": c}


def anchored(docs: DataFrame) -> DataFrame:
    """ah, uh, d, h, lo, n, c of every unit of docs (d, h, text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        u = units(texts_of(b.column(2)))
        doc = pa.array(u["doc"])
        cols = [pa.array(u["ah"].view(np.int64)), pa.array(u["uh"].view(np.int64)), b.column(0).take(doc), b.column(1).take(doc), *(pa.array(u[k].astype(np.int32)) for k in ("lo", "n", "c"))]
        return pa.RecordBatch.from_arrays(cols, ["ah", "uh", "d", "h", "lo", "n", "c"])

    return map_slices(docs, run, "ah bigint, uh bigint, d bigint, h bigint, lo int, n int, c int")


class SuffixArray:
    """The starts of some strings in order, with the common prefixes of neighbours.

    data: all strings one after another; begin, end: where each string lies; counted: how many of its first
    positions are starts.
    """

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, counted: np.ndarray):
        n = len(data)
        self.owner = np.repeat(np.arange(len(begin)), end - begin)
        self.end = end[self.owner]
        pos = np.arange(n)
        # nine bits a symbol, 0 past the end of the string
        padded = np.zeros(n + 8, dtype=np.uint64)
        padded[:n] = data.astype(np.uint64) + np.uint64(1)
        key = np.zeros(n, dtype=np.uint64)
        for k in range(7):
            key = (key << np.uint64(9)) | np.where(pos + k < self.end, padded[k : n + k], np.uint64(0))
        self.ranks, self.width = [self._rank(key)], [7]
        longest = int((end - begin).max()) if len(begin) else 0
        while self.width[-1] < longest:
            r, w = self.ranks[-1], self.width[-1]
            ahead = np.where(pos + w < self.end, r[np.minimum(pos + w, n - 1)] + 1, 0)
            self.ranks.append(self._rank(r.astype(np.uint64) * np.uint64(n + 1) + ahead.astype(np.uint64)))
            self.width.append(2 * w)
        starts = np.concatenate([np.arange(b, b + c) for b, c in zip(begin, counted, strict=True)]) if len(begin) else pos
        self.sa = starts[np.argsort(self.ranks[-1][starts], kind="stable")]
        self.begin, self.data = begin, data
        self.lcp = self._lcp(self.sa[:-1], self.sa[1:])

    @staticmethod
    def _rank(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        k = key[order]
        out = np.empty(len(key), dtype=np.int32)
        out[order] = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]])) if len(k) else 0
        return out

    def _lcp(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        most = np.minimum(self.end[x] - x, self.end[y] - y)
        h = np.zeros(len(x), dtype=np.int64)
        last = len(self.data) - 1
        for r, w in zip(reversed(self.ranks), reversed(self.width), strict=True):
            fits = h + w <= most
            same = fits & (r[np.minimum(x + h, last)] == r[np.minimum(y + h, last)])
            h += np.where(same, w, 0)
        for _ in range(6):
            same = (h < most) & (self.data[np.minimum(x + h, last)] == self.data[np.minimum(y + h, last)])
            h += same
        return h

    def left(self) -> np.ndarray:
        """The byte before each start; at the beginning of string i a value of its own, as it has no left byte."""
        first = self.sa == self.begin[self.owner[self.sa]]
        return np.where(first, 256 + self.owner[self.sa], self.data[np.maximum(self.sa - 1, 0)].astype(np.int64))

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(length, i, j) of each maximal repeat of `least` bytes or more: its occurrences are sa[i:j].

        Neighbours whose common prefix is shorter never share an interval, so runs between them are scanned
        one by one; a run without diversity has none inside either.
        """
        long = self.lcp >= least
        edge = np.flatnonzero(np.diff(np.concatenate([[0], long.view(np.int8), [0]])))
        left = self.left()
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            part = left[i : j + 1]
            if (part != part[0]).any():
                yield from _intervals(self.lcp[i:j].tolist(), part.tolist(), i)


_MANY = -1


def _intervals(lcp: list[int], left: list[int], at: int) -> Iterator[tuple[int, int, int]]:
    """Stack scan of one run: lcp[k] belongs to entries k and k + 1. Yields left-diverse intervals.

    Stack entries: common prefix, first entry, the left byte of all entries (or _MANY).
    """
    stack: list[list[int]] = []
    n = len(lcp)
    for k in range(n + 1):
        now = lcp[k] if k < n else -1
        first, byte = k, left[k]
        while stack and stack[-1][0] > now:
            depth, begun, seen = stack.pop()
            seen = seen if seen == byte else _MANY
            if seen == _MANY:
                yield depth, at + begun, at + k + 1
            first, byte = begun, seen
        if now >= 0:
            if stack and stack[-1][0] == now:
                if stack[-1][2] != byte:
                    stack[-1][2] = _MANY
            else:
                stack.append([now, first, byte])


def covered_spans(data: list[bytes], counted: list[int], copies: list[int], least: int = WIDTH) -> list[list[tuple[int, int]]]:
    """For each string the bytes that lie in a repeat: of the whole string, if it has copies, else by the tree."""
    length = np.array([len(x) for x in data], dtype=np.int64)
    end = np.cumsum(length)
    begin = end - length
    array = SuffixArray(np.frombuffer(b"".join(data), dtype=np.uint8), begin, end, np.array(counted, dtype=np.int64))
    spans: list[list[tuple[int, int]]] = [[(0, int(n))] if c > 1 else [] for n, c in zip(length, copies, strict=True)]
    found = list(array.maximal_repeats(least))
    if found:
        size = np.array([f[0] for f in found])
        a, b = np.array([f[1] for f in found]), np.array([f[2] for f in found])
        where = np.arange((b - a).sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a)
        pos, long = array.sa[where], np.repeat(size, b - a)
        own = array.owner[pos]
        keys = np.unique(np.stack([own, pos - begin[own], long], axis=1), axis=0)
        for i, s, n in keys.tolist():
            if copies[i] <= 1:
                spans[i].append((s, s + n))
    return [merged(s) for s in spans]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of some spans; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


_SPANS = "ah bigint, uh bigint, spans array<struct<s:int,e:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _as_spans(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], _SPAN_TYPE)


def sort_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of rows (ah, uh, copies, n, unit), which come ordered by ah and whole groups at a time."""
    rows: dict[tuple[int, int], tuple[int, int, bytes]] = {}
    size, last = 0, None

    def done() -> pa.RecordBatch:
        copies, counted, data = zip(*rows.values(), strict=True)
        spans = covered_spans(list(data), list(counted), list(copies))
        keep = [(k, s) for k, s in zip(rows, spans, strict=True) if s]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in keep], pa.int64()), pa.array([k[1] for k, _ in keep], pa.int64()), _as_spans([s for _, s in keep])], ["ah", "uh", "spans"])

    for b in batches:
        for ah, uh, copies, n, unit in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if ah != last and size >= SORT_BYTES:
                yield done()
                rows, size = {}, 0
            last = ah
            if (ah, uh) not in rows:
                rows[ah, uh] = (copies, n, unit)
                size += len(unit)
    if rows:
        yield done()


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ah, uh, copies, n, unit, big) of rows (text, asked: list of (ah, uh, copies, lo, n, big))."""
    for b in batches:
        for i in range(b.num_rows):
            text = b.column(0)[i].as_py().encode()
            asked = b.column(1).slice(i, 1).flatten()
            ah, uh, copies, lo, n, big = (asked.field(k) for k in range(6))
            unit = pa.array([text[s : s + c + WIDTH - 1] for s, c in zip(lo.to_pylist(), n.to_pylist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([ah, uh, copies, n, unit, big], ["ah", "uh", "copies", "n", "unit", "big"])


def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ah, uh, copies, off and the hash p of the WIDTH-byte prefix of every start of rows (ah, uh, copies, n, unit, big)."""
    for b in batches:
        for i in range(0, b.num_rows, 4096):
            part = b.slice(i, 4096)
            t = texts_of(part.column(4).cast(pa.large_binary()).view(pa.large_string()))
            n = part.column(3).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            s = t.offsets[:-1][row] + off
            p = t.span_hash(s, s + WIDTH)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), pa.array(off.astype(np.int32)), pa.array(p.view(np.int64))], ["ah", "uh", "copies", "off", "p"])


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """d, h and spans (array of s, e: bytes of the text that lie in a repeat) of documents (d, h, text) that have any."""
    all_units = scratch.write(anchored(docs), "units")
    counts = all_units.groupBy("ah").agg(F.sum("c").alias("total"), F.min("uh").alias("a"), F.max("uh").alias("b")).filter(F.col("total") > 1).select("ah", (F.col("a") != F.col("b")).alias("several"))
    again = scratch.write(all_units.join(counts, "ah"), "again")
    scratch.drop("units")

    sources = again.filter("several").groupBy("ah", "uh").agg(F.sum("c").alias("copies"), F.min(F.struct("d", "h", "lo", "n")).alias("src"))
    sources = scratch.write(sources.select("ah", "uh", F.least("copies", F.lit(2)).cast("int").alias("copies"), "src.*"), "sources")
    groups = sources.groupBy("ah").agg(F.count("*").alias("size")).filter(F.col("size") > GROUP_LIMIT).select("ah", F.lit(True).alias("big"))
    asked = sources.join(groups, "ah", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    asked = asked.groupBy("d", "h").agg(F.collect_list(F.struct("ah", "uh", "copies", "lo", "n", "big")).alias("asked"))
    cut = docs.join(asked.hint("shuffle_hash"), ["d", "h"]).select(F.coalesce("text", F.lit("")).alias("text"), "asked")
    cut = scratch.write(cut.mapInArrow(tidied(cut_out), "ah bigint, uh bigint, copies int, n int, unit binary, big boolean"), "cut")
    dealt = cut.filter("NOT big").select("ah", "uh", "copies", "n", "unit").repartition("ah").sortWithinPartitions("ah")
    by_tree = dealt.mapInArrow(tidied(sort_units), _SPANS)
    starts = cut.filter("big").dropDuplicates(["ah", "uh"]).mapInArrow(tidied(prefixes), "ah bigint, uh bigint, copies int, off int, p bigint")
    common = starts.groupBy("ah", "p").agg(F.sum("copies").alias("total")).filter(F.col("total") > 1).select("ah", "p")
    hit = starts.join(common, ["ah", "p"])
    by_prefix = hit.groupBy("ah", "uh").agg(F.collect_list(F.struct(F.col("off").alias("s"), (F.col("off") + WIDTH).alias("e"))).alias("spans"))
    found = scratch.write(by_tree.unionByName(by_prefix), "found")
    scratch.drop("cut", "sources")

    moved = F.transform("spans", lambda x: F.struct((x.s + F.col("lo")).alias("s"), (x.e + F.col("lo")).alias("e")))
    whole = F.array(F.struct(F.col("lo").alias("s"), (F.col("lo") + F.col("c") * F.col("n") + (WIDTH - 1)).alias("e")))
    runs = again.filter("several").join(found, ["ah", "uh"]).select("d", "h", F.when(F.col("c") > 1, whole).otherwise(moved).alias("spans"))
    full = again.filter("NOT several").select("d", "h", whole.alias("spans"))
    return runs.unionByName(full).groupBy("d", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def keyed(docs: DataFrame, d: str, h: str) -> DataFrame:
    """docs with columns d and h, 128 bits of the id and the text: rows of different texts never share both, and
    rows that do are equal, so that their spans are too."""
    return docs.withColumns({d: F.xxhash64(F.lit(1), "doc_id", "text"), h: F.xxhash64("text", "doc_id")})


def _rest(text: str | None, spans: pa.Scalar) -> tuple[bytes, int, list[tuple[int, int]]]:
    raw = (text or "").encode()
    if not spans.is_valid:
        return raw, len(raw), []
    v = spans.values
    s, e = v.field(0).to_numpy(), v.field(1).to_numpy()
    edge = np.zeros(len(raw) + 1, dtype=np.int32)
    np.add.at(edge, s, 1)
    np.add.at(edge, e, -1)
    gone = np.cumsum(edge[:-1]) > 0
    cut = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(raw), list(zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True))


def _with_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    prepared(docs.sparkSession).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    d, h, s = fresh(docs, "_d", "_h", "_spans")
    k = keyed(docs, d, h)
    spans = scratch.write(repeated_spans(k.select(F.col(d).alias("d"), F.col(h).alias("h"), "text"), scratch), "spans")
    scratch.drop("again", "found")
    found = spans.select(F.col("d").alias(d), F.col("h").alias(h), F.col("spans").alias(s)).hint("shuffle_hash")
    return k.join(found, [d, h], "left").select(*[F.col(f"`{c}`") for c in docs.columns], s)


def digests(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_rest(b.column(1)[i].as_py(), b.column(2)[i]) for i in range(b.num_rows)]
            cols = [b.column(0), pa.array([n for _, n, _ in rows], pa.int64()), pa.array([n - len(r) for r, n, _ in rows], pa.int64()), pa.array([len(s) for _, _, s in rows], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r, _, _ in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = _with_spans(docs.select("doc_id", "text"), scratch).mapInArrow(tidied(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return scratch.finish(out)


def remove_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with the repeated bytes cut out of text; rows and other columns stay.

    A cut may split a character; what is left of it is dropped, so that the text is valid UTF-8. A column
    n_chars, if there is one, is counted anew. A null text stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            texts, spans = b.column(at), b.column(b.num_columns - 1)
            new = [None if not texts[i].is_valid else _rest(texts[i].as_py(), spans[i])[0].decode("utf-8", "ignore") for i in range(b.num_rows)]
            yield b.set_column(at, b.schema.field(at), pa.array(new, texts.type)).select(b.schema.names[:-1])

    out = _with_spans(docs, scratch).mapInArrow(tidied(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
