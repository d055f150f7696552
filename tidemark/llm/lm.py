"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its bytes and an end (255, which UTF-8 doesn't use), cut into units after every white-space byte and
after UNIT bytes. A byte is a few binary decisions down a Huffman tree of the training texts' bytes. A decision
is predicted from four hashed contexts: the last one, three and five bytes of the unit, and the unit so far in
lower case. The first and the last also hold the text's kind, one of KINDS clusters of texts by their letter
pairs; the kind is paid for with the text. A prediction is the logarithm of the odds of what the training texts
did at that node of the tree in that context.

Predictions are mixed in two layers. In the first two sets of weights, fitted on all training texts, are each
chosen by a gate: one by the node's depth and how sure two contexts are, one by the kind and how sure the unit
so far is. The second adds up what the two sets say, with weights that begin equal in each text and follow the
gradient of its coding cost after every decision, from the text's first to its last. All decisions pass through it
but those of which both sets say nothing: they cost a bit and teach nothing, whatever the weights.

Nothing bounds the number of contexts, and their hashes get longer with the corpus: a context shares its hash
with another at most once in 2 ** SPARE_BITS. Counts are kept by context and byte, not by context and node, as a
node's count is a sum over neighbouring leaves.

1. Blocks. Texts are written as numbers of their block's distinct units, with byte counts (for the tree) and
   letter pairs (for the kinds, found by rounds of means over all training texts).
2. Units. Blocks send their distinct units, by range of the lower-case word's hash, with counts by kind. A range
   knows each distinct unit of the corpus once, and each word's count for the base score.
3. Contexts. Ranges of units send their sorted (context, byte) pairs and counts on by range of the context's
   hash. Those ranges sum them and answer with the predictions along each byte's path.
4. Weights. Ranges of units fit their own by Newton steps, each occurrence taken out of the counts that predict
   it, and Spark adds up solutions weighted by curvature.
5. Scores. Ranges of units mix the first layer and answer each block, PASSES parts of the blocks one after the other,
   so that few answers are on disk at once. Blocks mix the second layer, decision by decision, many texts side by side.

The numbers of ranges grow with the corpus; no task holds a whole table, and neither does the driver, which sees
256 byte counts, KINDS means and the sums for the weights.

Null and empty texts have one token, the end. Repeated rows are scored each. Other columns are ignored. Without
training documents all counts are 0, N and V are 0, and base scores use c = 0. Texts of any length are scored
whole: a block holds one text at least, and takes some 40 times its bytes of memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pandas import factorize
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import prepared
from .exchange import ASKED, batch_of, blocks, by_range, codes, numbered, pack, ragged, ranges_for, summed, unpack
from .text import BATCH_ROWS, IS_WORD, LOWER, Scratch, Texts, held_out, mix, powers, texts_of, tidied

END = 255
BACK = (1, 3, 5)
CONTEXTS = len(BACK) + 1
UNIT = 64
KINDS, PAIRS, ROUNDS = 16, 64, 5
#: Where a unit stands: after a unit that ends in a letter, in a comma or the like, or a sentence; at a line's start.
STATES = 4
MORE = KINDS * STATES
DEPTHS = 6
GATES = 72  # of either set: DEPTHS * 4 * 3, and KINDS * 4 places at most
LAST_GATES = 4
SCALE = np.float32(0.25)  # of predictions in whole numbers
FINE = np.float32(0.25)  # of the first layer's predictions in whole numbers
RATE = 0.003
FIRST = 0.5
SPARE_BITS = 12
ROWS = 1  # of blocks or ranges that a worker gets at once
PASSES = 3  # parts of the blocks that are answered one after the other
CHUNK = 1 << 17  # decisions that are put in order at once
SLAB = 1 << 16  # decisions that are looked up at once
FEW = 100  # lanes that are mixed over many decisions at once
WINDOW = 1 << 13  # decisions of few lanes that are mixed at once
RUNS = 16  # decisions of a lane that follow each other in a column of a window, at most
SAME = np.float32(1e-5)  # odds, halved, that further rounds needn't change
PIECE = 1 << 14  # bytes of units whose decisions are made at once
MOST = 80  # nats that a decision costs at most

_RNG = np.random.default_rng(5)
_SALT = _RNG.integers(1, 2**63, CONTEXTS, dtype=np.uint64)
#: By kind and state; then those of units that go on in the middle of a long word.
_KIND = _RNG.integers(1, 2**63, 2 * MORE, dtype=np.uint64)
_ODDS = np.float32(0.1)
_ONE = np.float32(1)
_LEAST = np.float32(np.exp(-MOST))


def with_ends(t: Texts) -> Texts:
    return Texts(np.insert(t.data, t.offsets[1:], END), t.offsets + np.arange(t.n + 1))


def whole_numbers(x: np.ndarray, scale: np.float32 = SCALE) -> np.ndarray:
    return np.clip(np.rint(x / scale), -127, 127).astype(np.int8)


def stretched(taken: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Log odds in whole numbers of SCALE: swapped counts give the negative."""
    return whole_numbers(np.log(taken.astype(np.float32) + _ODDS) - np.log(other.astype(np.float32) + _ODDS))


# --- the tree of bytes -------------------------------------------------------------------------------------


class Tree:
    """A Huffman tree of byte counts. Leaves are numbered from left to right; a node is a span of leaves."""

    def __init__(self, counts: np.ndarray):
        share = np.maximum(counts / max(counts.sum(), 1), 2.0**-20)
        heap = [(float(s), b, b) for b, s in enumerate(share)]
        heapq.heapify(heap)
        number = 256
        while len(heap) > 1:
            (s, _, x), (r, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (s + r, number, (x, y)))
            number += 1
        paths: list[tuple[int, list[int]]] = []  # byte and first leaf of each node on its path

        def walk(node, above: list[int]) -> None:
            now = [*above, len(paths)]
            if isinstance(node, int):
                paths.append((node, now))
            else:
                walk(node[0], now)
                walk(node[1], now)

        walk(heap[0][2], [])
        self.leaf = np.zeros(256, dtype=np.uint8)
        self.length = np.zeros(256, dtype=np.int64)  # by leaf
        self.first = np.repeat(np.arange(256)[None], max(len(p) for _, p in paths), axis=0)  # [depth, leaf]
        for i, (b, p) in enumerate(paths):
            self.leaf[b], self.length[i] = i, len(p) - 1
            self.first[: len(p), i] = p

    def predictions(self, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted distinct pairs (context << 8 | leaf) and their counts the contexts' counts and, one after another, the predictions on each pair's path."""
        leaf = (keys & np.uint64(255)).astype(np.int64)
        context = keys >> np.uint64(8)
        start = np.concatenate([[0], np.cumsum(self.length[leaf])])
        out = np.empty(start[-1], dtype=np.int8)
        row = np.arange(len(keys))
        total = whole = _group_sums(n, context, np.zeros(len(keys), np.int64))
        for d in range(len(self.first) - 1):
            deep = np.flatnonzero(self.length[leaf] > d)
            if not len(deep):
                break
            row, leaf, context, n, total = row[deep], leaf[deep], context[deep], n[deep], total[deep]
            taken = _group_sums(n, context, self.first[d + 1][leaf])
            out[start[row] + d] = stretched(taken, total - taken)
            total = taken
        return whole, out


def _group_sums(n: np.ndarray, context: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row the sum of n over its neighbours of the same context and node."""
    if not len(n):
        return n
    new = np.concatenate([[True], (context[1:] != context[:-1]) | (first[1:] != first[:-1])])
    return np.add.reduceat(n, np.flatnonzero(new))[np.cumsum(new) - 1]


# --- blocks of texts ---------------------------------------------------------------------------------------


class Cut:
    """Texts (without ends) as numbers of their distinct units.

    before: units before each text (n + 1 values); unit: their numbers; u: the distinct units; more: which of
    them go on in the middle of a long word; long_doc, long_hash: the words that are longer than a unit.
    """

    def __init__(self, texts: Texts):
        t = with_ends(texts)
        cut = ~IS_WORD[t.data]
        cut[t.offsets[1:] - 1] = True
        ends = np.flatnonzero(cut) + 1
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        more = np.zeros(len(ends), dtype=bool)
        self.long_doc, self.long_hash = np.empty(0, np.int64), np.empty(0, np.uint64)
        over = np.flatnonzero(ends - starts > UNIT)
        if len(over):
            low = Texts(LOWER[t.data], t.offsets)
            self.long_doc, self.long_hash = t.doc_of(starts[over]), low.span_hash(starts[over], ends[over] - 1)
            parts = -(-(ends - starts) // UNIT)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            starts, more = np.repeat(starts, parts) + UNIT * nth, nth > 0
            ends = np.concatenate([starts[1:], [len(t.data)]])
        self.before = np.searchsorted(starts, t.offsets)
        _, seen, self.unit = numbered(unit_hashes(t.data, starts, ends - starts) ^ np.where(more, _KIND[MORE], np.uint64(0)))
        size = (ends - starts)[seen]
        at, off = ragged(starts[seen], size)
        self.u, self.more = Texts(t.data[at], off), more[seen]

    def packed(self) -> bytes:
        return pack(np.diff(self.before), self.unit, np.diff(self.u.offsets), self.u.data, self.more, self.long_doc, self.long_hash)

    @classmethod
    def read(cls, data: bytes) -> Cut:
        out = cls.__new__(cls)
        many, out.unit, size, raw, more, out.long_doc, out.long_hash = unpack(data)
        out.before = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        out.u = Texts(raw.astype(np.uint8), np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
        out.unit, out.more, out.long_doc = out.unit.astype(np.int64), more.astype(bool), out.long_doc.astype(np.int64)
        return out

    def entries(self, kind: np.ndarray, train: np.ndarray) -> None:
        """Orders the distinct units by their words' hashes, and numbers the distinct units with kind and state accordingly.

        unit_order, word: the units in order and their words' hashes; entry_unit (a place in that order),
        entry_kind (kind and state; MORE is added if the unit goes on) and entry_n (occurrences in training texts) are of each
        entry; entry: each occurrence's.
        """
        word = word_hashes(self.u)
        self.unit_order = np.argsort(word, kind="stable")
        self.word = word[self.unit_order]
        place = np.empty(self.u.n, dtype=np.int64)
        place[self.unit_order] = np.arange(self.u.n)
        doc = np.repeat(np.arange(len(self.before) - 1), np.diff(self.before))
        state = np.concatenate([[STATES - 1], endings(self.u)[self.unit[:-1]]]) if len(self.unit) else self.unit
        state[self.before[:-1]] = STATES - 1
        both, number = codes(place[self.unit] * MORE + kind[doc] * STATES + state)
        order = np.argsort(both)
        rank = np.empty(len(both), dtype=np.int64)
        rank[order] = np.arange(len(both))
        self.entry = rank[number]
        both = both[order]
        self.entry_unit = both // MORE
        self.entry_kind = both % MORE + MORE * self.more[self.unit_order[self.entry_unit]]
        self.entry_n = np.bincount(self.entry, weights=train[doc], minlength=len(both)).astype(np.int64)


def unit_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each unit's bytes, taken eight at a time; sizes are UNIT at most."""
    eight = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(eight[start] & _LOW[np.minimum(size, 8)] ^ size.astype(np.uint64) * _SALT[0])
    for k in range(8, UNIT, 8):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        h[more] = mix(h[more] * _SALT[1] ^ eight[start[more] + k] & _LOW[np.minimum(size[more] - k, 8)])
    return h


#: The lowest bytes of a number, by how many.
_LOW = np.array([2 ** (8 * k) - 1 for k in range(9)], dtype=np.uint64)


def endings(u: Texts) -> np.ndarray:
    """The state of what follows each unit."""
    last = u.data[u.offsets[1:] - 1]
    mark = u.data[np.maximum(u.offsets[1:] - 2, u.offsets[:-1])]
    return np.where((last != 32) & (~IS_WORD[last] | (last == END)), 3, np.where(np.isin(mark, list(b".!?")), 2, np.isin(mark, list(b",;:")).astype(np.int64)))


def word_hashes(u: Texts) -> np.ndarray:
    """A hash of each unit's lower-case bytes but the last."""
    return Texts(LOWER[u.data], u.offsets).span_hash(u.offsets[:-1], u.offsets[1:] - 1)


def are_words(u: Texts, kind: np.ndarray) -> np.ndarray:
    """Whether units are whole words with what ends them."""
    last = u.data[u.offsets[1:] - 1] if u.n else u.data
    return (kind < MORE) & (np.diff(u.offsets) > 1) & (~IS_WORD[last] | (last == END))


def letter_pairs(t: Texts) -> np.ndarray:
    """For each text PAIRS numbers: the root of how often its pairs of bytes fall into each class, in a byte."""
    low = LOWER[t.data].astype(np.uint16)
    doc = np.repeat(np.arange(t.n, dtype=np.int32) * PAIRS, np.diff(t.offsets))
    if len(low):
        doc[1:] += _PAIR_CLASS[low[:-1] << np.uint16(8) | low[1:]]
    m = np.bincount(doc[1:], minlength=t.n * PAIRS)
    m = np.sqrt(m.reshape(t.n, PAIRS))
    return np.rint(255 * m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1)).astype(np.uint8)


_PAIR_CLASS = (mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(77)) >> np.uint64(58)).astype(np.uint8)


def kinds_of(pairs: np.ndarray, means: np.ndarray) -> np.ndarray:
    return (pairs.astype(np.float32) @ means.T.astype(np.float32)).argmax(axis=1) if len(pairs) else np.empty(0, np.int64)


# --- ranges of units ---------------------------------------------------------------------------------------


def unit_questions(c: Cut, train: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """What a block (whose entries are known) asks each range: its units, its entries with counts, and its long words."""
    low = np.uint64(64 - (ranges.bit_length() - 1))
    at = np.searchsorted(c.word >> low if ranges > 1 else np.zeros(len(c.word), np.uint64), np.arange(ranges + 1, dtype=np.uint64))
    e = np.searchsorted(c.entry_unit, at)
    size = np.diff(c.u.offsets)[c.unit_order]
    start = c.u.offsets[:-1][c.unit_order]
    long = _long_words(c, train)
    for j in range(ranges):
        p, q = slice(at[j], at[j + 1]), slice(e[j], e[j + 1])
        words = [x[(long[0] >> low if ranges > 1 else np.zeros(len(long[0]), np.uint64)) == j] for x in long]
        if at[j] < at[j + 1] or len(words[0]):
            yield j, pack(size[p], c.u.data[ragged(start[p], size[p])[0]], c.entry_unit[q] - at[j], c.entry_kind[q], c.entry_n[q], *words)


def _long_words(c: Cut, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return summed(c.long_hash, train[c.long_doc].astype(np.int64))


def merged_units(asked: list[tuple[int, bytes]]) -> tuple[bytes, list[tuple[int, bytes]], int, int]:
    """A range's distinct entries, and for each block which of them it asks for, with the counts of its long words.

    Then the number of distinct training words, and of their occurrences.
    """
    parts = [unpack(d) for _, d in asked]
    size = np.concatenate([p[0].astype(np.int64) for p in parts])
    all_units = Texts(np.concatenate([p[1].astype(np.uint8) for p in parts]), np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    unit = np.concatenate([p[2].astype(np.int64) + b for p, b in zip(parts, base, strict=False)])
    kind = np.concatenate([p[3].astype(np.int64) for p in parts])
    n = np.concatenate([p[4].astype(np.int64) for p in parts])
    h = all_units.span_hash(all_units.offsets[:-1], all_units.offsets[1:])
    _, first, number = numbered(mix(h[unit] ^ _KIND[kind]) if len(unit) else h[:0])
    times = np.bincount(number, weights=n, minlength=len(first)).astype(np.int64)
    one, kind = unit[first], kind[first]
    u = Texts(*_taken(all_units, one))
    word, is_word = word_hashes(u), are_words(u, kind)
    long = np.concatenate([p[5].astype(np.uint64) for p in parts])
    words, c = summed(np.concatenate([word[is_word], long]), np.concatenate([times[is_word], *(p[6].astype(np.int64) for p in parts)]))
    of_word = np.zeros(len(first), dtype=np.int64)
    of_word[is_word] = c[np.searchsorted(words, word[is_word])]
    back, at = [], np.cumsum([0, *(len(p[2]) for p in parts)])
    for i, (block, _) in enumerate(asked):
        back.append((block, pack(number[at[i] : at[i + 1]], c[np.searchsorted(words, parts[i][5].astype(np.uint64))])))
    return pack(np.diff(u.offsets), u.data, kind, times, of_word), back, int((c > 0).sum()), int(c.sum())


def _taken(t: Texts, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, off = ragged(t.offsets[some], np.diff(t.offsets)[some])
    return t.data[at], off


class Units:
    """A range's distinct entries: their decisions, and the sorted pairs (context << 8 | leaf) that predict them."""

    def __init__(self, data: bytes, tree: Tree, bits: int):
        size, raw, kind, times, self.of_word = unpack(data)
        self.u = Texts(raw.astype(np.uint8), np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
        self.kind, self.times, self.tree = kind.astype(np.int64), times.astype(np.int64), tree
        self.leaf = tree.leaf[self.u.data].astype(np.int64)
        shift = np.uint64(64 - bits)
        leaf = self.leaf.astype(np.uint64)
        asked = [factorize((x >> shift) << np.uint64(8) | leaf)[::-1] for x in self.contexts()]  # a third of the time of `codes` where most are distinct
        weight = np.repeat(self.times, np.diff(self.u.offsets)).astype(np.float64)
        keys = np.concatenate([a[0] for a in asked])
        n = np.concatenate([np.bincount(a[1], weights=weight, minlength=len(a[0])) for a in asked])
        order = np.argsort(keys)
        rank = np.empty(len(keys), dtype=np.int64)
        rank[order] = np.arange(len(keys))
        self.keys, self.n = keys[order], n[order].astype(np.int64)
        at = np.cumsum([0, *(len(a[0]) for a in asked)])
        #: for each context the pair of each byte
        self.pair = [rank[b : b + len(a[0])][a[1]] for b, a in zip(at, asked, strict=False)]

    def contexts(self) -> list[np.ndarray]:
        """A hash for each context and byte."""
        u = self.u
        n, size = len(u.data), np.diff(u.offsets)
        begin = np.repeat(u.offsets[:-1], size)
        at = np.arange(n)
        place = at - begin
        kind = np.repeat(_KIND[self.kind // STATES * STATES], size)
        last, out = np.zeros(n, dtype=np.uint64), []
        for k in range(1, BACK[-1] + 1):
            last[k:] |= (u.data[: max(n - k, 0)] * (place[k:] >= k)).astype(np.uint64) << np.uint64(8 * (k - 1))
            if k in BACK:
                out.append(mix(last ^ _SALT[len(out)]))
        out[0] = mix(out[0] ^ np.where(place == 0, np.repeat(_KIND[self.kind], size), kind))
        sums = Texts(LOWER[u.data], u.offsets).prefix()
        _, down = powers(n + 1)
        out.append(mix((sums[:-1] - np.repeat(sums[u.offsets[:-1]], size)) * down[begin] + place.astype(np.uint64) ^ _SALT[-1] ^ kind))
        return out

    def answered(self, whole: np.ndarray, odds: np.ndarray) -> Units:
        """Takes the contexts' counts and the predictions on the pairs' paths."""
        length = self.tree.length
        self.begin = np.concatenate([[0], np.cumsum(length[(self.keys & np.uint64(255)).astype(np.int64)])]).astype(np.int64)
        self.whole, self.odds = whole, odds
        steps = length[self.leaf]
        self.step_at = np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)
        self.unit_at = self.step_at[self.u.offsets]  # where each unit's decisions begin
        return self

    def pieces(self, odds: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Some decisions at a time: which, their predictions (decisions x contexts) and their gates in the two sets."""
        place = np.minimum(np.arange(len(self.leaf)) - np.repeat(self.u.offsets[:-1], np.diff(self.u.offsets)), 3)
        by_kind = (np.repeat(self.kind % MORE // STATES * 4, np.diff(self.u.offsets)) + place).astype(np.uint8)
        length, words = self.tree.length[(self.keys & np.uint64(255)).astype(np.int64)], np.zeros((len(self.keys), 8), dtype=np.int8)
        for d in range(8):  # each pair's first predictions, to be taken at once
            there = np.flatnonzero(length > d)
            words[there, d] = odds[self.begin[there] + d]
        words = words.view(np.uint64).ravel()
        for a in range(0, len(self.leaf), PIECE):
            b = min(a + PIECE, len(self.leaf))
            size = np.diff(self.step_at[a : b + 1])
            run = np.arange(size.sum())
            run -= np.repeat(self.step_at[a:b] - self.step_at[a], size)
            some = _FIRST[np.minimum(size, 8)]
            first = np.empty((b - a, 8, CONTEXTS), dtype=np.int8)
            for k, p in enumerate(self.pair):
                first[:, :, k] = words.take(p[a:b]).view(np.int8).reshape(-1, 8)
            x = first.view(np.uint32)[:, :, 0][some].view(np.int8).reshape(-1, CONTEXTS)
            if len(x) < len(run):
                low, x = x, np.empty((len(run), CONTEXTS), dtype=np.int8)
                x.view(np.uint32).ravel()[run < 8] = low.view(np.uint32).ravel()
                later, byte = np.flatnonzero(run >= 8), np.repeat(np.arange(a, b), np.maximum(size - 8, 0))
                for k, p in enumerate(self.pair):
                    x[later, k] = odds[self.begin[p[byte]] + run[later]]
            sure = _SURE_WORD[x[:, -1].view(np.uint8)] + _SURE_LONG[x[:, -2].view(np.uint8)]
            sure += _DEPTH[run]
            yield slice(self.step_at[a], self.step_at[b]), x, sure, np.repeat(by_kind[a:b], size)

    def decisions(self, odds: np.ndarray) -> np.ndarray:
        """A key of each decision: its predictions (one byte a context) and its gates in the two sets, which is all the first layer knows of it."""
        out = np.empty(self.step_at[-1], dtype=np.uint64)
        for here, x, sure, by_kind in self.pieces(odds):
            gate = sure.astype(np.uint16) << np.uint16(8) | by_kind
            out[here] = x.view(np.uint32).ravel().astype(np.uint64) << np.uint64(16) | gate
        return out

    def without_one(self) -> np.ndarray:
        """The predictions, less one occurrence of each pair. Counts are worked out from odds, from the context's down."""
        out = np.empty_like(self.odds)
        leaf = (self.keys & np.uint64(255)).astype(np.int64)
        n, row = self.whole.astype(np.float32), np.arange(len(self.keys))
        for d in range(len(self.tree.first) - 1):
            deep = np.flatnonzero(self.tree.length[leaf] > d)
            if not len(deep):
                break
            row, leaf, n = row[deep], leaf[deep], n[deep]
            x = self.odds[self.begin[row] + d].astype(np.float32) * SCALE
            taken = np.clip(np.rint((n + 2 * _ODDS) / (1 + np.exp(-x)) - _ODDS), 0, n)
            out[self.begin[row] + d] = stretched(np.maximum(taken - 1, 0), n - taken)
            n = taken
        return out

    def mixed(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first layer: for each unit the cost of the decisions of which it says nothing and the number of the others; the others' two predictions."""
        # a weight's product with each value that a prediction can have, in steps of FINE
        tables = [[np.outer(w[:, k], _VALUES / FINE).astype(np.float32).ravel() for k in range(CONTEXTS)] for w in weights]
        z = np.empty((self.step_at[-1], 2), dtype=np.int8)
        for here, x, *gates in self.pieces(self.odds):
            value = [x[:, k].view(np.uint8).astype(np.int64) for k in range(CONTEXTS)]
            for j, (of_context, gate) in enumerate(zip(tables, gates, strict=True)):
                row = gate.astype(np.int64) << 8
                total = of_context[0].take(row | value[0], mode="clip")
                for k in range(1, CONTEXTS):
                    total += of_context[k].take(row | value[k], mode="clip")
                z[here, j] = whole_numbers(total, _ONE)
        if not self.u.n:
            return np.empty(0), np.empty(0, np.int64), z
        left = z.view(np.uint16).ravel() != 0
        many = np.add.reduceat(left, self.unit_at[:-1], dtype=np.int64)
        return (np.diff(self.unit_at) - many) * np.log(2), many, z[left]


def opened(keys: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The predictions decisions x contexts and the two gates that keys of decisions stand for. Both outcomes of a decision have the same gates."""
    x = (keys >> np.uint64(16)).astype(np.uint32).view(np.int8).reshape(-1, CONTEXTS).astype(np.float32) * SCALE
    return x, ((keys >> np.uint64(8) & np.uint64(255)).astype(np.uint8), (keys & np.uint64(255)).astype(np.uint8))


_VALUES = np.arange(256, dtype=np.uint8).view(np.int8).astype(np.float32) * SCALE
_SIZE = np.abs(np.arange(256, dtype=np.uint8).view(np.int8).astype(np.int16))
_SURE_WORD = (3 * np.searchsorted([3, 7, 13], _SIZE, side="right")).astype(np.uint8)
_SURE_LONG = np.searchsorted([4, 12], _SIZE, side="right").astype(np.uint8)
_FIRST = np.arange(8) < np.arange(9)[:, None]
_DEPTH = (12 * np.minimum(np.arange(256), DEPTHS - 1)).astype(np.uint8)


def first_weights() -> np.ndarray:
    return np.full((2, GATES, CONTEXTS), 0.3, dtype=np.float32)


def _times(keys: np.ndarray, n: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training texts' decisions, and how often they occur: of units that occur n times, keys of 48 bits, size for each
    unit. Those of the most frequent units may come twice. Keys are overwritten."""
    often = np.flatnonzero(n >> 16)
    at = ragged((np.cumsum(size) - size)[often], size[often])[0]
    more = keys[at], np.repeat(n[often], size[often])
    keys <<= np.uint64(16)
    keys |= np.repeat(np.where(n >> 16, 0, n).astype(np.uint64), size)
    keys.sort()  # cheaper than a hash table
    times = (keys & np.uint64(0xFFFF)).astype(np.int64)
    keys >>= np.uint64(16)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    keys, times = np.concatenate([keys[first], more[0]]), np.concatenate([np.add.reduceat(times, first) if len(first) else times, more[1]])
    return keys[times > 0], times[times > 0].astype(np.float32)


def regression(u: Units, rounds: int = 3, pull: float = 20.0) -> np.ndarray:
    """Curvature, and curvature times solution, of a range's own weights: 2 x GATES x CONTEXTS x (CONTEXTS + 1)."""
    out = np.zeros((2, GATES, CONTEXTS, CONTEXTS + 1))
    start = first_weights().astype(np.float64)
    keys, times = _times(u.decisions(u.without_one()), u.times, np.diff(u.unit_at))
    x, both = opened(keys)
    for k, gate in enumerate(both):
        order = np.argsort(gate, kind="stable")
        sorted_x, sorted_times = x[order], times[order]
        edge = np.searchsorted(gate[order], np.arange(GATES + 1))
        for g in np.flatnonzero(np.diff(edge)):
            v = start[k, g].copy()
            a, t = sorted_x[edge[g] : edge[g + 1]], sorted_times[edge[g] : edge[g + 1]]
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(a @ v.astype(np.float32), -12, 12)))
                grad = a.T @ (t * (1 - p))
                h = ((a * (t * p * (1 - p))[:, None]).T @ a).astype(np.float64)
                v = v + np.clip(np.linalg.solve(h + pull * np.eye(CONTEXTS), grad - pull * (v - start[k, g])), -0.5, 0.5)
            out[k, g, :, :-1], out[k, g, :, -1] = h, h @ v
    return out


def joined(sums: np.ndarray, pull: float = 20.0) -> np.ndarray:
    """The weights that all ranges' regressions together ask for, drawn to equal weights by `pull`."""
    h, right = sums[..., :-1] + pull * np.eye(CONTEXTS), sums[..., -1] + pull * first_weights()
    return np.clip(np.linalg.solve(h, right[..., None])[..., 0], -1, 2).astype(np.float32)


# --- the second layer --------------------------------------------------------------------------------------


_BOTH = np.arange(1 << 16, dtype=np.uint16).view(np.int8).reshape(-1, 2)
_BOTH_GATE = np.searchsorted([2, 5, 10], np.abs(_BOTH.astype(np.int16).sum(axis=1)), side="right").astype(np.uint8)
_BOTH_ODDS = np.ascontiguousarray(_BOTH.T * float(FINE))


class Answers:
    """What a block knows of its entries: the cost that is sure whatever the weights, where the decisions to be mixed begin, their predictions.

    A decision's two predictions are one number of 16 bits in z, the column of x and the place in gate that hold
    their values and the second layer's gate.
    """

    x, gate = _BOTH_ODDS, _BOTH_GATE

    def __init__(self, sure: np.ndarray, many: np.ndarray, z: np.ndarray):
        self.sure, self.at = sure, np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        self.z = np.ascontiguousarray(z).view(np.uint16).ravel() if len(z) else np.empty(0, np.uint16)


def score(c: Cut, a: Answers, kind_bits: np.ndarray) -> np.ndarray:
    """Bits of each text (with its end and its kind)."""
    many = np.diff(c.before)
    doc = np.repeat(np.arange(len(many)), many)
    return (np.bincount(doc, weights=a.sure[c.entry], minlength=len(many)) + _second_layer(c, a)) / np.log(2) + kind_bits


def _lanes(c: Cut, a: Answers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The decisions of all texts by lane: a text's decisions with one gate, in their order, as only these move that gate's weights.

    Each lane's size, where it starts, and the decisions' numbers, with SLAB more at the end. Lanes of one gate follow
    each other, as texts do.
    """
    n = len(c.before) - 1
    many = np.diff(a.at)[c.entry]
    done = np.concatenate([[0], np.cumsum(many)])
    total, edges = done[c.before], _edges(done[1:])
    size = np.zeros((LAST_GATES, n), dtype=np.int64)
    parts: list[list[np.ndarray]] = [[] for _ in range(LAST_GATES)]
    doc = np.repeat(np.arange(n), np.diff(c.before))
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        number = a.z.take(ragged(a.at[c.entry[s:e]], many[s:e])[0])
        gate = a.gate.take(number)
        if s == e:
            continue
        d0, d1 = doc[s], doc[e - 1] + 1
        cut = np.clip(total[d0 : d1 + 1], done[s], done[e]) - done[s]
        for g in range(LAST_GATES):
            there = np.flatnonzero(gate == g)
            parts[g].append(number.take(there))
            size[g, d0:d1] += np.diff(np.searchsorted(there, cut))
    out = np.concatenate([*(x for p in parts for x in p), np.zeros(SLAB, np.uint16)])
    size = size.ravel()
    return size, np.cumsum(size) - size, out


def _edges(done: np.ndarray) -> np.ndarray:
    """Where rows are cut for some CHUNK decisions to be put in order at once; done: decisions up to the end of each row."""
    return np.concatenate([[0], np.flatnonzero(np.diff(done // CHUNK)) + 1, [len(done)]]) if len(done) else np.zeros(1, np.int64)


def _second_layer(c: Cut, a: Answers) -> np.ndarray:
    """The cost of each text's mixed decisions. The weights move after every one, before the next is predicted."""
    size, start, numbers = _lanes(c, a)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    # both predictions and weights are scaled, for the rate to be 1
    unit, cost = np.sqrt(RATE), np.zeros(len(size))
    w = np.full((2, len(size)), FIRST / unit, dtype=np.float32)
    t, m = 0, int(np.count_nonzero(size))
    multiply, add, divide, exp = np.multiply, np.add, np.divide, np.exp  # small arrays, many calls
    with np.errstate(over="ignore", under="ignore"):  # of odds that are sure beyond what a number can hold
        while m > FEW:  # the m longest lanes side by side, from their t-th decisions on
            until = min(t + max(SLAB // m, 1), max(int(size[m - 1 - m // 4]), t + 1))
            number, left, over = _numbers(numbers, start[:m], size[:m], t, until)
            x = np.empty((until - t, 2, m), dtype=np.float32)
            np.multiply(number.view(np.int8).reshape(m, -1, 2).transpose(1, 2, 0), np.float32(FINE * unit), out=x)
            odds, v, part = np.empty((until - t, m), dtype=np.float32), np.ascontiguousarray(w[:, :m]), np.empty((2, m), dtype=np.float32)
            first, second = part
            for u, e in zip(x, odds, strict=True):  # an error is 1 / (1 + odds)
                multiply(v, u, part)
                add(first, second, first)
                exp(first, e)
                add(e, _ONE, first)
                divide(u, first, u)
                add(v, u, v)
            odds.T[left:][over] = np.inf
            cost[:m] += _costs(odds).sum(axis=0, dtype=np.float64)
            w[:, :m] = v
            t, m = until, int(np.searchsorted(-size, -until))
        while m:
            until = min(t + max(min(SLAB, WINDOW) // m, 1), max(int(size[m - 1 - m // 4]), t + 1))
            number, left, over = _numbers(numbers, start[:m], size[:m], t, until)
            x = np.multiply(number.view(np.int8).reshape(m, -1, 2).transpose(2, 0, 1), np.float32(-FINE * unit / 2), order="C")
            half, move = _window(x, w[:, :m])
            w[:, :m] -= move
            half[left:][over] = -np.inf
            half *= np.float32(-2)
            cost[:m] += _costs(np.exp(half, out=half)).sum(axis=1, dtype=np.float64)
            t, m = until, int(np.searchsorted(-size, -until))
    out = np.empty(len(size))
    out[order] = cost
    return out.reshape(LAST_GATES, -1).sum(axis=0)


def _numbers(numbers: np.ndarray, start: np.ndarray, size: np.ndarray, t: int, until: int) -> tuple[np.ndarray, int, np.ndarray]:
    """The decisions t to until of lanes, longest first; from which lane on they are filled up, and where."""
    number = as_strided(numbers, (len(numbers) - until + t + 1, until - t), numbers.strides * 2)[start + t]
    left = int(np.searchsorted(-size, -until, side="right"))
    over = np.arange(t, until) >= size[left:, None]
    number[left:][over] = 0
    return number, left, over


def _costs(odds: np.ndarray) -> np.ndarray:
    """What decisions cost whose odds (not their logarithms) are these, which are overwritten; MOST at most."""
    np.maximum(odds, _LEAST, out=odds)
    np.divide(_ONE, odds, out=odds)
    np.add(odds, _ONE, out=odds)
    return np.log(odds, out=odds)


def _window(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The negative odds, halved, of decisions x (2, lanes, decisions), and how far the weights w (2, lanes) move down.

    The same chain as step by step: what each decision's odds are follows from the errors of those before it. Rounds
    work out all errors from the last round's odds until these stay as they are. A round makes at least one more
    decision of each lane right, and weights move so little that some rounds are enough for all.

    A lane's decisions lie in RUNS rows at most, one after another in a column, so that the sums of all columns are made
    side by side.
    """
    _, m, n = x.shape
    columns = -(-n // RUNS)
    rows = -(-n // columns)
    y = np.zeros((2, m, columns * rows), dtype=np.float32)
    np.multiply(x, np.float32(-2), out=y[:, :, :n])
    y = np.ascontiguousarray(y.reshape(2, m, columns, rows).transpose(3, 0, 1, 2)).reshape(rows, 2, -1)
    move, before = y * np.repeat(w, columns, axis=1), np.zeros_like(y)
    alone = move[:, 0] + move[:, 1]
    odds, new, error = alone, np.empty_like(alone), np.empty_like(alone)
    apart = [1 << k for k in range((rows - 1).bit_length())]
    with np.errstate(over="ignore", under="ignore"):
        for _ in range(n + 1):
            np.exp(odds, out=error)
            error += _ONE
            np.divide(y, error[:, None], out=move)
            ends = move.sum(axis=0).reshape(2, m, columns).cumsum(axis=2)
            before[0].reshape(2, m, columns)[:, :, 1:] = ends[:, :, :-1]
            before[1:] = move[:-1]
            for k in apart:
                before[k:] += before[:-k]
            np.multiply(y, before, out=move)
            new[:] = move[:, 0]
            new += move[:, 1]
            new += alone
            np.subtract(new, odds, out=error)
            if np.abs(error, out=error).max() <= 2 * SAME:
                break
            odds, new = new, odds if odds is not alone else np.empty_like(alone)
    return new.reshape(rows, m, columns).transpose(1, 2, 0).reshape(m, -1)[:, :n] * np.float32(-0.5), -ends[:, :, -1]


# --- ranges of contexts ------------------------------------------------------------------------------------

#: Contexts' counts go back in a byte: up to 31 as they are, then in eighths of a doubling.
_COUNTS = np.concatenate([np.arange(32), np.round(32 * 2.0 ** (np.arange(1, 225) / 8))])
#: Pairs that a range adds up at a time.
_MERGE = 1 << 22


def _rounded(n: np.ndarray) -> np.ndarray:
    return np.clip(np.searchsorted(_COUNTS, n, side="right") - 1, 0, 255).astype(np.uint8)


def pair_questions(keys: np.ndarray, n: np.ndarray, bits: int, ranges: int) -> Iterator[tuple[int, bytes]]:
    """What a range of units asks each range of contexts: its sorted pairs and counts."""
    cut = np.arange(1, ranges, dtype=np.uint64) << np.uint64(8 + bits - (ranges.bit_length() - 1))
    at = [0, *np.searchsorted(keys, cut).tolist(), len(keys)]
    for j, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if s < e:
            yield j, pack(np.diff(keys[s:e] >> np.uint64(8), prepend=np.uint64(0)), (keys[s:e] & np.uint64(255)).astype(np.uint8), n[s:e])


def _pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    context, leaf, n = unpack(data)
    return np.cumsum(context, dtype=np.uint64) << np.uint64(8) | leaf.astype(np.uint64), n.astype(np.int64)


def pair_answers(asked: list[tuple[int, bytes]], tree: Tree) -> Iterator[tuple[int, bytes]]:
    """For each that asks the counts of its contexts and the predictions on its pairs' paths."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for i, (_, d) in enumerate(asked):
        kept.append(_pairs(d))
        if sum(len(k) for k, _ in kept[1:]) > _MERGE or i + 1 == len(asked):
            kept = [summed(np.concatenate([k for k, _ in kept]), np.concatenate([v for _, v in kept]))]
    keys, n = kept[0]
    whole, odds = tree.predictions(keys, n)
    whole, odds = _rounded(whole), odds.view(np.uint8)
    size = tree.length[(keys & np.uint64(255)).astype(np.int64)]
    begin = np.cumsum(size) - size
    for who, d in asked:
        at = np.searchsorted(keys, _pairs(d)[0])
        yield who, pack(whole[at], odds[ragged(begin[at], size[at])[0]])


def read_answers(found: list) -> tuple[np.ndarray, np.ndarray]:
    pieces = [unpack(p["data"]) for p in sorted(found or [], key=lambda p: p["idx"])]
    whole, odds = (np.concatenate([p[k] for p in pieces]) if pieces else np.empty(0, np.uint8) for k in (0, 1))
    return _COUNTS[whole.astype(np.int64)], odds.astype(np.uint8).view(np.int8)


# --- the jobs ----------------------------------------------------------------------------------------------


def in_blocks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, held) in blocks: block, ids, held, data (the cut texts), sizes (their bytes), pairs (their letter pairs) and counts (of the training texts' bytes)."""
    prepared(docs.sparkSession).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for n, b in enumerate(blocks(batches), 1):
            t = texts_of(b.column(1))
            held = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            own = np.bincount(t.data[np.repeat(~held, np.diff(t.offsets))], minlength=256)
            own[END] = (~held).sum()
            cols = [pa.array([task + n]), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_())), pa.array([Cut(t).packed()], pa.binary()), pa.array([np.diff(t.offsets).tolist()], pa.list_(pa.int64())), pa.array([letter_pairs(t).tobytes()], pa.binary()), pa.array([own.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["block", "ids", "held", "data", "sizes", "pairs", "counts"])

    return docs.mapInArrow(tidied(run), "block bigint, ids array<bigint>, held array<boolean>, data binary, sizes array<bigint>, pairs binary, counts array<bigint>")


def find_kinds(written: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The kinds' means, and their shares of the training texts. They begin at KINDS texts with the smallest hashes of their places."""
    one = written.select("block", "pairs", F.posexplode("held").alias("i", "held")).filter("NOT held")
    first = one.select(F.xxhash64("block", "i").alias("h"), F.substring("pairs", F.col("i") * PAIRS + 1, F.lit(PAIRS)).alias("p")).orderBy("h", "p").limit(KINDS).collect()
    means = np.zeros((KINDS, PAIRS))
    for i, r in enumerate(first):
        means[i] = np.frombuffer(bytes(r.p), np.uint8)
    count = np.zeros(KINDS)
    for _ in range(ROUNDS):
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)

        def run(batches: Iterator[pa.RecordBatch], means: np.ndarray = means) -> Iterator[pa.RecordBatch]:
            total = np.zeros((KINDS, PAIRS + 1))
            for b in batches:
                for held, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    p = np.frombuffer(raw, np.uint8).reshape(-1, PAIRS)[~np.array(held, dtype=bool)]
                    k = kinds_of(p, means)
                    for j in range(KINDS):
                        total[j, :-1] += p[k == j].sum(axis=0)
                    total[:, -1] += np.bincount(k, minlength=KINDS)
            yield batch_of("i int, v double", np.arange(total.size, dtype=np.int32), total.ravel())

        sums = np.zeros(KINDS * (PAIRS + 1))
        for r in written.select("held", "pairs").mapInArrow(tidied(run), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            sums[r.i] = r.v
        sums = sums.reshape(KINDS, PAIRS + 1)
        count = sums[:, -1]
        means = np.where(count[:, None] > 0, sums[:, :-1], means)
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    return means.astype(np.float32), (count + 1) / (count.sum() + KINDS)


def _block(batch: pa.RecordBatch, i: int, means: np.ndarray) -> tuple[Cut, np.ndarray, np.ndarray]:
    """The cut texts of row i (held, data, pairs), which are held out, and their kinds."""
    held = np.array(batch.column("held")[i].as_py(), dtype=bool)
    kind = kinds_of(np.frombuffer(batch.column("pairs")[i].as_py(), np.uint8).reshape(-1, PAIRS), means)
    c = Cut.read(batch.column("data")[i].as_py())
    c.entries(kind, ~held)
    return c, held, kind


def score_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row."""
    spark = prepared(docs.sparkSession)
    written = scratch.write(in_blocks(docs.select("doc_id", "text", held_out(F.col("doc_id"), 7, 2).alias("held"))), "texts")
    seen = np.zeros(256)
    for r in written.select(F.posexplode("counts").alias("byte", "n")).groupBy("byte").agg(F.sum("n").alias("n")).collect():
        seen[r.byte] = r.n
    bytes_of = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x) + F.size("sizes")
    size, ends = written.agg(F.coalesce(F.sum(bytes_of), F.lit(0)).alias("n")).first().n, int(seen[END])
    tree, bits = Tree(seen), min(56, size.bit_length() + SPARE_BITS)
    ranges = ranges_for(size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    means, share = find_kinds(written)
    means_of_kinds = means

    def ask_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c, held, _ = _block(batch, i, means_of_kinds)
                for j, data in unit_questions(c, ~held, ranges):
                    yield batch_of(ASKED, [batch.column("block")[i].as_py()], [j], [data])

    def merge(idx: int, asked: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        data, back, distinct, occurrences = merged_units(asked)
        cols = [pa.array([idx], pa.int32()), pa.array([data], pa.binary()), pa.array([[{"who": w, "data": d} for w, d in back]], pa.list_(pa.struct([("who", pa.int64()), ("data", pa.binary())]))), pa.array([distinct], pa.int64()), pa.array([occurrences], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["idx", "data", "asks", "distinct", "occurrences"])

    units = scratch.write(by_range(written.select("block", "held", "data", "pairs").mapInArrow(tidied(ask_units), ASKED), merge, "idx int, data binary, asks array<struct<who:bigint,data:binary>>, distinct bigint, occurrences bigint"), "units")
    total = units.agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("v"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("n")).first()
    distinct, tokens = total.v + (ends > 0), total.n + ends

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for idx, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u = Units(data, tree, bits)
                for j, question in pair_questions(u.keys, u.n, bits, ranges):
                    yield batch_of(ASKED, [idx], [j], [question])

    def answer(idx: int, asked: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for who, data in pair_answers(asked, tree):
            yield batch_of(ASKED, [who], [idx], [data])

    scratch.forget()
    pairs = scratch.write(by_range(units.select("idx", "data").mapInArrow(tidied(ask_pairs), ASKED), answer, ASKED), "pairs")
    scratch.forget()
    found = pairs.groupBy(F.col("who").cast("int").alias("idx")).agg(F.collect_list(F.struct("idx", "data")).alias("found"))
    known = scratch.write(units.select("idx", "data", "asks").join(found, "idx", "left"), "known")
    del units, pairs, found
    scratch.drop("units", "pairs")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, GATES, CONTEXTS, CONTEXTS + 1))
        for batch in batches:
            for i in range(batch.num_rows):
                total += regression(Units(batch.column(0)[i].as_py(), tree, bits).answered(*read_answers(batch.column(1)[i].as_py())))
        yield batch_of("i int, v double", np.arange(total.size, dtype=np.int32), total.ravel())

    sums = np.zeros(2 * GATES * CONTEXTS * (CONTEXTS + 1))
    for r in known.select("data", "found").mapInArrow(tidied(fit), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r.i] = r.v
    weights = joined(sums.reshape(2, GATES, CONTEXTS, CONTEXTS + 1))

    def mix_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                u = Units(batch.column(1)[i].as_py(), tree, bits).answered(*read_answers(batch.column(3)[i].as_py()))
                sure, many, z = u.mixed(weights)
                z[:, 1] -= z[:, 0]
                z = z.view(np.uint8)
                data = pack(np.rint(sure / np.log(2)).astype(np.int64), many, u.of_word, z[:, 0].copy(), z[:, 1].copy())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], pa.array([data], pa.binary()), batch.column(2)[i : i + 1]], ["idx", "data", "asks"])

    def answer_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                idx, data, asks = (batch.column(k)[i].as_py() for k in range(3))
                even, many, of_word, low, high = unpack(data) if asks else [np.empty(0, np.uint8)] * 5
                many = many.astype(np.int64)
                at = np.cumsum(many) - many
                for ask in asks:
                    e, long = (x.astype(np.int64) for x in unpack(ask["data"]))
                    rows = ragged(at[e], many[e])[0]
                    yield batch_of(ASKED, [ask["who"]], [idx], [pack(even[e], many[e], of_word[e], low[rows], high[rows], long)])

    log_total = float(np.log10(tokens + distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c, held, kind = _block(batch, i, means_of_kinds)
                n = len(held)
                pieces = [unpack(p["data"]) for p in sorted(batch.column("found")[i].as_py() or [], key=lambda p: p["idx"])]
                even, many, count, low, high, long = (np.concatenate([p[k] for p in pieces]) if pieces else np.empty(0, np.uint64) for k in range(6))
                low, high = low.astype(np.uint8), high.astype(np.uint8)
                z = np.stack([low, low + high], axis=1).view(np.int8)
                a = Answers(even * np.log(2), many.astype(np.int64), z)
                del pieces, low, high, z
                u = Texts(*_taken(c.u, c.unit_order[c.entry_unit]))
                word = are_words(u, c.entry_kind)[c.entry]
                doc = np.concatenate([np.repeat(np.arange(n), np.diff(c.before))[word], c.long_doc])
                long_at = np.searchsorted(_long_words(c, ~held)[0], c.long_hash)
                count = np.concatenate([count.astype(np.int64)[c.entry[word]], long.astype(np.int64)[long_at]])
                tokens_of = np.bincount(doc, minlength=n) + 1
                base = np.bincount(doc, weights=np.log10(count + 1), minlength=n) + np.log10(ends + 1) - tokens_of * log_total
                in_training = np.bincount(doc, weights=count > 0, minlength=n).astype(np.int64) + (ends > 0)
                paid = score(c, a, -np.log2(share[kind]))
                sizes = np.array(batch.column("sizes")[i].as_py(), dtype=np.int64)
                cols = [pa.array(batch.column("ids")[i].as_py(), pa.int64()), pa.array(held), pa.array(tokens_of), pa.array(in_training), pa.array(base), pa.array(-paid * np.log10(2)), pa.array(paid / (sizes + 1))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

    first = scratch.write(known.select("idx", "data", "asks", "found").mapInArrow(tidied(mix_first), "idx int, data binary, asks array<struct<who:bigint,data:binary>>"), "first")
    del known
    scratch.drop("known")
    parts = []
    for k in range(PASSES):

        def here(block: Column, k: int = k) -> Column:
            return F.pmod(F.xxhash64(block), F.lit(PASSES)) == k

        back = first.select("idx", "data", F.filter("asks", lambda x: here(x.who)).alias("asks")).mapInArrow(tidied(answer_blocks), ASKED)
        back = back.groupBy(F.col("who").alias("block")).agg(F.collect_list(F.struct("idx", "data")).alias("found"))
        full = written.filter(here(F.col("block"))).select("block", "ids", "held", "data", "sizes", "pairs").join(back, "block", "left").drop("block")
        parts.append(scratch.write(full.mapInArrow(tidied(run), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, bits_per_byte double"), f"scores{k}"))
        del back, full
        scratch.forget()
    out = reduce(DataFrame.union, parts)
    del written, first
    scratch.drop("texts", "first")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "bits_per_byte")
