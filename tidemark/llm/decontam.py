"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

A document is contaminated by an item when some stretch of it is within the item's edit budget: word
insertions, deletions and substitutions of at most EDIT_SHARE of the item's words. Words are runs of letters,
digits and bytes over 127; case of A-Z and punctuation don't count.

1. Embedding. The CGK random walk writes the current word at each step and moves on or stays by a random bit of
   the step and the word, so that texts at a small edit distance get embeddings at a small Hamming distance. It
   is taken from every word of the documents and of the items, in WALKS independent walks of STEPS steps.
2. Index. From each walk REPEATS samples of SAMPLES coordinates make keys. Every place of an item is in the
   tables, every place of a document is looked up, and a hit says where an item-sized window would begin. Repeats
   by places and walks bring the recall: a window is missed only if no place of it has a sample without an edit.
3. Verification. Each window that was hit, with the budget's slack on both sides, is compared with its item by
   exact edit distance in words.

Items of under LEAST_WORDS words have no budget: their whole word sequence is one key, and an exact copy is a
match. Null items and items without words match nothing. Items are taken in blocks of at most BLOCK_BYTES of
text, each block in one pass over the documents, so what goes to the executors has a fixed bound however large
the benchmark is. Repeated documents and items are judged each for itself; empty tables give empty results. Whole
texts are searched, at some 100 times a text's bytes of memory if it is over 1 MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Texts, map_slices, mix, texts_of

EDIT_SHARE = 0.25
LEAST_WORDS = 8
WALKS, STEPS, REPEATS, SAMPLES, PLACES = 6, 8, 2, 4, 4
BLOCK_BYTES = 1 << 20
#: Hits that are worked on at a time.
HITS = 1 << 18
_PAD = np.uint64(0)
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_K = np.uint64(0xD1342543DE82EF95)
_RNG = np.random.default_rng(11)
_SALT = _RNG.integers(1, 2**63, WALKS, dtype=np.uint64)
#: The sampled coordinates of each walk and repeat; the first one is always there, as it says where the place is.
SAMPLED = [[sorted([0, *_RNG.choice(np.arange(1, STEPS), SAMPLES - 1, replace=False).tolist()]) for _ in range(REPEATS)] for _ in range(WALKS)]


def word_hashes(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts, and the words before each text (n + 1 values)."""
    starts, ends = t.runs(_IN_WORD[t.data])
    return t.span_hash(starts, ends) | np.uint64(1), np.searchsorted(starts, t.offsets)


def budget(words: int) -> int:
    return min(int(EDIT_SHARE * words), words // 3 - 1) if words >= LEAST_WORDS else 0


def sample_keys(h: np.ndarray, stop: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Number and keys of each sample, one for each word: what the walk from there wrote at the sampled steps.

    stop: for each word where its text ends; a walk that gets there has the key PAD, and so has one whose samples are
    of fewer than PLACES places: as it stayed, they say too little. Without it walks run on.
    """
    n = len(h)
    if not n:
        return
    last = np.full(n, n) if stop is None else stop
    for w, repeats in enumerate(SAMPLED):
        bits = mix(h ^ _SALT[w])
        wanted = {i for r in repeats for i in r}
        pos, wrote, places = np.arange(n), {}, {}
        for i in range(max(wanted) + 1):
            at = np.minimum(pos, n - 1)
            if i in wanted:
                places[i] = pos.copy() if stop is not None else None
                wrote[i] = h.take(at, mode="clip") if stop is None else np.where(pos < last, h[at], _PAD)
            pos += (bits.take(at, mode="clip") >> np.uint64(i) & np.uint64(1)).astype(np.int64)
        for r, coords in enumerate(repeats):
            key, bad = np.full(n, w * REPEATS + r + 1, dtype=np.uint64), np.zeros(n, dtype=bool)
            for i in coords:
                key *= _K
                key += wrote[i]
                if stop is not None:
                    bad |= wrote[i] == _PAD
            if stop is not None:
                bad |= 1 + sum((places[j] != places[i]).astype(np.int64) for i, j in pairwise(coords)) < PLACES
            key = mix(key) | np.uint64(1)
            yield w * REPEATS + r, key if stop is None else np.where(bad, _PAD, key)


def sequence_keys(h: np.ndarray, words: int) -> np.ndarray:
    """A hash of each `words` neighbouring words."""
    n = max(len(h) - words + 1, 0)
    v = np.full(n, words, dtype=np.uint64)
    for k in range(words):
        v = v * _K + h[k : n + k]
    return mix(v) | np.uint64(1)


class Table:
    """Keys of items' places: item and offset of each, sorted by key, behind a filter of one byte a slot."""

    def __init__(self, key: np.ndarray, item: np.ndarray, off: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.off = key[order], item[order], off[order]
        self.mask = np.uint64(max(1 << 16, 1 << (16 * len(key)).bit_length()) - 1)
        self.filter = np.zeros(int(self.mask) + 1, dtype=bool)
        self.filter[(self.key >> np.uint64(8) & self.mask).astype(np.int64)] = True

    def hits(self, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Place, item and offset of what is found, HITS at a time (or those of one place)."""
        p = np.flatnonzero(self.filter.take((key >> np.uint64(8) & self.mask).astype(np.int64), mode="clip"))
        a, b = np.searchsorted(self.key, key[p]), np.searchsorted(self.key, key[p], side="right")
        p, a, n = p[b > a], a[b > a], (b - a)[b > a]
        cut = np.flatnonzero(np.diff(np.cumsum(n) // HITS, prepend=0)) if len(n) else []
        for rows in np.split(np.arange(len(p)), cut):
            if len(rows):
                row = np.repeat(rows, n[rows])
                at = a[row] + np.arange(len(row)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
                yield p[row], self.item[at], self.off[at]


class Items:
    """A block of benchmark items, ready for search."""

    def __init__(self, ids: list[int], texts: list[str]):
        t = texts_of(pa.array(texts, pa.large_string()), lower=True)
        self.h, self.at = word_hashes(t)
        self.ids = np.array(ids, dtype=np.int64)
        self.words = np.diff(self.at)
        self.budget = np.array([budget(w) for w in self.words.tolist()], dtype=np.int64)
        item = np.repeat(np.arange(len(ids)), self.words)
        off = np.arange(len(item)) - self.at[item]
        long = self.words[item] >= LEAST_WORDS if len(item) else np.empty(0, bool)
        self.tables: dict[int, Table] = {}
        for k, key in sample_keys(self.h, self.at[item + 1] if len(item) else None):
            use = np.flatnonzero(long & (key != _PAD))
            self.tables[k] = Table(key[use], item[use], off[use])
        self.short: dict[int, Table] = {}
        for n in sorted({n for n in self.words.tolist() if 0 < n < LEAST_WORDS}):
            own = np.flatnonzero(self.words == n)
            self.short[n] = Table(sequence_keys(self.h, n)[self.at[own]], own, np.zeros(len(own), np.int64))

    def search(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, item (positions in the block) and edits of each match in lower-cased texts, one for each pair."""
        h, at = word_hashes(t)
        doc_of = np.repeat(np.arange(t.n), np.diff(at))
        places = [np.empty((0, 3), np.int64)]
        for k, key in sample_keys(h):
            for p, item, off in self.tables[k].hits(key) if len(self.tables[k].key) else ():
                places.append(np.unique(np.stack([doc_of[p], item, p - off], axis=1), axis=0))
        place = np.unique(np.concatenate(places), axis=0)
        place = place[np.argsort(self.words[place[:, 1]], kind="stable")]  # items of like sizes together
        edits = np.empty(len(place), dtype=np.int64)
        s = 0
        while s < len(place):
            e = s + 1
            e = min(len(place), s + max(1, (1 << 18) // int(2 * self.words[place[min(s + 1023, len(place) - 1), 1]] + 1)), s + 1024)
            edits[s:e] = self._edits(h, at, place[s:e])
            s = e
        good = edits <= self.budget[place[:, 1]]
        place, edits = place[good], edits[good]
        exact = [np.empty((0, 3), np.int64)]
        for n, table in self.short.items():
            for p, item, _ in table.hits(sequence_keys(h, n)):
                inside = doc_of[p] == doc_of[p + n - 1]
                exact.append(np.stack([doc_of[p], item, p], axis=1)[inside])
        place = np.concatenate([place, *exact])
        edits = np.concatenate([edits, np.zeros(len(place) - len(edits), np.int64)])
        order = np.lexsort((edits, place[:, 1], place[:, 0]))
        place, edits = place[order], edits[order]
        first = np.concatenate([[True], (place[1:, :2] != place[:-1, :2]).any(axis=1)]) if len(place) else np.empty(0, bool)
        return place[first, 0], place[first, 1], edits[first]

    def _edits(self, h, at, place) -> np.ndarray:
        """Exact edit distance of each item to the closest stretch around each place (document, item, start)."""
        doc, item, start = place.T
        size = self.words[item]
        slack = self.budget[item]
        low = np.maximum(start - slack, at[doc])
        width = np.minimum(start + size + slack, at[doc + 1]) - low
        columns = int(width.max())
        col = np.arange(columns)
        inside = col < width[:, None]
        text = np.where(inside, h[np.minimum(low[:, None] + col, len(h) - 1)], _PAD)
        row = np.zeros((len(place), columns + 1), dtype=np.int32)  # a stretch may begin anywhere
        out = np.full(len(place), 1 << 30, dtype=np.int64)
        out[size == 0] = 0
        ramp = np.arange(columns + 1, dtype=np.int32)
        for i in range(int(size.max())):
            word = self.h[np.minimum(self.at[item] + i, len(self.h) - 1)]
            new = np.empty_like(row)
            new[:, 0] = i + 1
            new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (text != word[:, None]))
            row = np.minimum.accumulate(new - ramp, axis=1) + ramp
            done = size == i + 1
            if done.any():  # and end anywhere
                best = np.where(np.concatenate([np.ones((done.sum(), 1), bool), inside[done]], axis=1), row[done], 1 << 30)
                out[done] = best.min(axis=1)
        return out


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of at most BLOCK_BYTES of text (or one item)."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).toLocalIterator():
        if size and size + len(r.text) > BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    if ids:
        yield Items(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_words (of the item) and edits of each document and item that match."""
    schema = "doc_id bigint, item_id bigint, n_words bigint, edits bigint"

    def search(items: Items) -> DataFrame:
        def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
            doc, item, edits = items.search(texts_of(b.column(1), lower=True))
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(items.ids[item]), pa.array(items.words[item]), pa.array(edits)], ["doc_id", "item_id", "n_words", "edits"])

        return map_slices(docs.select("doc_id", "text"), run, schema)

    found = [search(items) for items in blocks(benchmark)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that match no item; all columns stay."""
    out = docs
    for items in blocks(benchmark):

        def run(b: pa.RecordBatch, items: Items = items) -> pa.RecordBatch:
            hit = np.zeros(b.num_rows, dtype=bool)
            hit[items.search(texts_of(b.column(b.schema.get_field_index("text")), lower=True))[0]] = True
            return b.filter(pa.array(~hit))

        out = map_slices(out, run, docs.schema)
    return out
