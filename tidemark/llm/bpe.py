"""BPE encoding and decoding through one table of the corpus's distinct words.

1. Split. Each text is cut into words: white space and what follows it up to the next, which no piece of the
   byte-level pre-tokenizer crosses. Blocks of texts are written as numbers of their distinct words, in rows of a
   part of the block each, and a worker holds no more of a block than its words' numbers.
2. Encode. Blocks send their distinct words out by range of hash. A range knows each distinct word of the corpus
   once, encodes it once, and sends each block its words' ids.
3. Join back. A block puts the ids of its words at the words' positions, row by row.
4. Decode. Ids are joined with the id-to-piece table, which is as large as the vocabulary (some 50,000 pieces)
   whatever the input, and the pieces' bytes put together.

No row is shuffled for a word's occurrence: a block asks for each distinct word once, in one packed row for each
range. A word that makes up a third of all text is one entry in each block.

Nulls are empty texts (no ids). Repeated rows are encoded each; other columns are ignored; an empty table gives an
empty result. The special string of the vocabulary file inside a text is one id, which is the library's default.
Texts of any length are encoded whole; a text of over 1 MB takes some 60 times its bytes of memory.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepared
from .exchange import ASKED, batch_of, blocks, by_range, numbered, pack, ragged, ranges_for, skewed, unpack, unskewed
from .text import BATCH_ROWS, BYTE_CHARS, IS_WORD, Scratch, Texts, byte_level, mix, texts_of, tidied

#: Distinct pieces that a worker keeps encoded; beyond that it starts a new table.
TABLE_LIMIT = 400_000
BLOCK, ROW, PART = 32 << 20, 4 << 20, 1 << 20  # bytes of text in a block, of those in a row, and of those that are worked on at a time
#: Fixed: the byte-level pre-tokenizer's pattern.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a word is: some pieces of the pattern; one piece that the library cut; a special token.
PLAIN, PIECE, SPECIAL = 0, 1, 2
_KIND = np.random.default_rng(17).integers(1, 2**63, 3, dtype=np.uint64)

#: Bytes that are in no text of which the library's tables of letters, digits and spaces and those here surely agree:
#: NUL and separators, and the first bytes of characters from U+2000 on.
_ODD = np.zeros(256, dtype=bool)
_ODD[[0, 28, 29, 30, 31, *range(0xE2, 0x100)]] = True


class WordTable:
    """Encoding of words and decoding of ids for one tokenizer file of the byte-level kind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.model = self.tok.model
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.words_re = regex.compile(WORDS)
        #: White space and what follows it up to the next. No piece of the pattern crosses such a border.
        self.chunks_re = re.compile(r"\s*\S+|\s+")
        self.plain = regex.compile("[\x01-\x1b\x20-\u1fff]*")
        #: How special tokens begin.
        self.heads = {s.encode()[:2] for s in self.special}
        self.pieces = pa.array(self._pieces(), pa.large_binary())
        lengths = np.diff(np.frombuffer(self.pieces.buffers()[1], dtype=np.int64))
        self.piece_len, self.piece_at = lengths, np.concatenate([[0], np.cumsum(lengths)])
        self.piece_bytes = np.frombuffer(self.pieces.buffers()[2], dtype=np.uint8)
        self.known: dict[str, list[int]] = {}

    def _pieces(self) -> list[bytes]:
        """The bytes of each id: byte-level characters stand for one byte each."""
        byte_of = {c: b for b, c in enumerate(BYTE_CHARS)}
        n = self.tok.get_vocab_size(with_added_tokens=True)
        return [s.encode() if (s := self.tok.id_to_token(i)) in self.special else bytes(byte_of[c] for c in s) for i in range(n)]

    def split(self, text: str) -> list[tuple[int, str]]:
        """The words of a text, with what they are."""
        out, at = [], 0
        for m in self.special_re.finditer(text) if self.special else ():
            out += self._split_plain(text[at : m.start()])
            out.append((SPECIAL, m.group()))
            at = m.end()
        return out + self._split_plain(text[at:])

    def _split_plain(self, text: str) -> list[tuple[int, str]]:
        if self.plain.fullmatch(text):
            return [(PLAIN, c) for c in self.chunks_re.findall(text)]
        # rare characters: the library's own pieces
        return [(PIECE, w) for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def ids_of(self, kind: int, word: str) -> list[int]:
        if kind == SPECIAL:
            return [self.special[word]]
        if kind == PIECE:
            return [t.id for t in self.model.tokenize(word)]
        out: list[int] = []
        for w in self.words_re.findall(word):
            ids = self.known.get(w)
            if ids is None:
                if len(self.known) > TABLE_LIMIT:
                    self.known.clear()
                ids = self.known[w] = [t.id for t in self.model.tokenize(byte_level(w))]
            out += ids
        return out

    def encode_words(self, words: Texts, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some distinct words, and how many each has."""
        raw, at = words.data.tobytes(), words.offsets.tolist()
        each = [self.ids_of(k, raw[s:e].decode()) for k, s, e in zip(kind.tolist(), at[:-1], at[1:], strict=True)]
        size = np.array([len(x) for x in each], dtype=np.int64)
        return np.fromiter((i for x in each for i in x), dtype=np.int64, count=int(size.sum())), size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a few texts in memory, and where each text's ids start (n + 1 values)."""
        c = Block([Split(texts_of(pa.array(texts, pa.large_string())), self)])
        return Places(c.number, c.before, c.place, *self.encode_words(c.words, c.kind)).ids(0, len(texts))

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Each text's bytes: ids joined with their pieces. Invalid UTF-8 becomes U+FFFD, as in the library."""
        where, ends = ragged(self.piece_at[ids], self.piece_len[ids])
        raw, cut = self.piece_bytes.take(where, mode="clip").tobytes(), ends[at].tolist()
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Split:
    """Texts as numbers of their distinct words.

    before: words before each text (n + 1 values); number: of each word in its place; words, kind and h: the
    distinct ones, and their hashes.
    """

    def __init__(self, t: Texts, table: WordTable):
        n = len(t.data)
        space = ~IS_WORD[t.data]
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[t.offsets[:-1][np.diff(t.offsets) > 0]] = True
        odd = _ODD[t.data]
        # white space that is not ASCII, and what may begin a special token
        for pair in [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", *table.heads]:
            odd[:-1] |= (t.data[:-1] == pair[0]) & (t.data[1:] == pair[1])
        slow = np.unique(t.doc_of(np.flatnonzero(odd)))
        raw = t.data
        starts = np.flatnonzero(start)
        ends = np.concatenate([starts[1:], [n]]) if len(starts) else starts
        kind = np.zeros(len(starts), dtype=np.int64)
        doc = t.doc_of(starts)
        if len(slow):  # their words come from Python, and may be shorter or longer than what they stand for
            keep = ~np.isin(doc, slow)
            extra, parts, at = [], [], n
            for d in slow.tolist():
                for k, w in table.split(t.data[t.offsets[d] : t.offsets[d + 1]].tobytes().decode()):
                    b = w.encode()
                    extra.append((d, at, at + len(b), k))
                    parts.append(b)
                    at += len(b)
            more = np.array(extra, dtype=np.int64).reshape(-1, 4)
            raw = np.concatenate([raw, np.frombuffer(b"".join(parts), np.uint8)])
            doc, starts, ends, kind = (np.concatenate([x[keep], y]) for x, y in zip((doc, starts, ends, kind), more.T, strict=True))
            order = np.argsort(doc, kind="stable")
            doc, starts, ends, kind = doc[order], starts[order], ends[order], kind[order]
        self.before = np.searchsorted(doc, np.arange(t.n + 1))
        self.h, first, self.number = numbered(mix(Texts(raw, np.array([0, len(raw)])).span_hash(starts, ends) ^ _KIND[kind]))
        size = (ends - starts)[first]
        at, off = ragged(starts[first], size)
        self.words, self.kind = Texts(raw[at], off), kind[first]


class Block:
    """Some splits as one: the most frequent words come first, and `place` is the range that each one's hash falls into."""

    def __init__(self, parts: list[Split], ranges: int = 1):
        h, first, number = numbered(np.concatenate([p.h for p in parts]))
        cut = np.cumsum([0, *(len(p.h) for p in parts)])
        times = np.bincount(number, np.concatenate([np.bincount(p.number, minlength=len(p.h)) for p in parts]), len(h))
        place = (h >> np.uint64(65 - ranges.bit_length())).astype(np.int64) if ranges > 1 else np.zeros(len(h), np.int64)
        order = np.lexsort((place, -times))  # words that are as frequent come range by range
        rank = np.empty(len(h), dtype=np.int64)
        rank[order] = np.arange(len(h))
        self.parts, self.ranks, first, self.place = parts, np.split(rank[number], cut[1:-1]), first[order], place[order]
        size = np.concatenate([np.diff(p.words.offsets) for p in parts])
        at, off = ragged((np.cumsum(size) - size)[first], size[first])
        self.words, self.kind = Texts(np.concatenate([p.words.data for p in parts])[at], off), np.concatenate([p.kind for p in parts])[first]

    def numbers(self, s: int, e: int) -> np.ndarray:
        """The words of parts s to e in their places."""
        return np.concatenate([r.take(p.number) for r, p in zip(self.ranks[s:e], self.parts[s:e], strict=True)])

    @property
    def number(self) -> np.ndarray:
        return self.numbers(0, len(self.parts))

    @property
    def before(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.before) for p in self.parts]))]).astype(np.int64)

    def questions(self) -> Iterator[tuple[int, bytes]]:
        """The distinct words for each range of hashes."""
        size, start = np.diff(self.words.offsets), self.words.offsets[:-1]
        order = np.argsort(self.place, kind="stable")
        head = np.flatnonzero(np.diff(self.place[order], prepend=-1)).tolist()
        for s, e in zip(head, [*head[1:], len(order)], strict=True):
            own = order[s:e]
            yield int(self.place[own[0]]), pack(size[own], self.words.data[ragged(start[own], size[own])[0]], self.kind[own])


class Places:
    """Words' places in texts, and the ids of the distinct words, which come range by range."""

    def __init__(self, number: np.ndarray, before: np.ndarray, place: np.ndarray, ids: np.ndarray, size: np.ndarray):
        order = np.argsort(place, kind="stable")
        start = np.empty(len(order), dtype=np.int64)
        start[order] = np.cumsum(size) - size
        many = np.empty(len(order), dtype=np.int64)
        many[order] = size
        self.number, self.before, self.all_ids, self.start, self.many = number, before, ids, start, many

    def ids(self, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts s to e, and where each text's begin (one more value than texts)."""
        word = self.number[self.before[s] : self.before[e]]
        where, ends = ragged(self.start.take(word, mode="clip"), self.many.take(word, mode="clip"))
        return self.all_ids.take(where, mode="clip"), ends[self.before[s : e + 1] - self.before[s]]


@lru_cache(maxsize=2)
def table(path: str) -> WordTable:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTable(path)


def answers(asked: list[tuple[int, bytes]], t: WordTable) -> Iterator[tuple[int, bytes]]:
    """The ids of each block's words. A word is encoded once, however many blocks ask for it."""
    parts = [unpack(d) for _, d in asked]
    size = np.concatenate([p[0].astype(np.int64) for p in parts])
    every = Texts(np.concatenate([p[1].astype(np.uint8) for p in parts]), np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
    kind = np.concatenate([p[2].astype(np.int64) for p in parts])
    _, first, number = numbered(mix(every.span_hash(every.offsets[:-1], every.offsets[1:]) ^ _KIND[kind]))
    at, off = ragged(every.offsets[:-1][first], size[first])
    ids, many = t.encode_words(Texts(every.data[at], off), kind[first])
    begin = np.cumsum(many) - many
    cut = np.cumsum([0, *(len(p[0]) for p in parts)])
    for (who, _), s, e in zip(asked, cut[:-1], cut[1:], strict=True):
        own = number[s:e]
        found = ids[ragged(begin[own], many[own])[0]]
        yield who, pack(many[own], (found & 255).astype(np.uint8), found >> 8)
    t.known.clear()  # no other range has these words


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    edge = np.flatnonzero(np.diff(x, prepend=x[:1] - 1))
    return edge, np.concatenate([edge[1:], [len(x)]]) if len(edge) else edge


#: Rows of a block: its texts' words by number (places), its distinct words (words), and the ranges that these fall into (heads).
SPLIT = "part string, block bigint, ids array<bigint>, data binary"
HEAD = -1  # stands before all ranges


def split_rows(batches: Iterator[pa.RecordBatch], t: WordTable, ranges: int, base: int) -> Iterator[pa.RecordBatch]:
    """The rows SPLIT of the blocks that texts (doc_id, text) make, numbered from base + 1. Texts go as soon as their words are numbered."""
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def row(part: str, ids: list | None, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, base, ids, pack(*columns)), kinds, strict=True)], ["part", "block", "ids", "data"])

    def rows(kept: list) -> Iterator[pa.RecordBatch]:
        ids, parts, size, h = zip(*kept, strict=True)
        c = Block(parts, ranges)
        yield row("words", None, np.diff(c.words.offsets), c.words.data, c.kind, c.place)
        yield row("heads", None, c.place)
        start = np.cumsum([0, *(x.sum() for x in size[:-1])])
        for s, e in zip(*(x.tolist() for x in _runs(start // ROW)), strict=True):
            many = np.concatenate([np.diff(p.before) for p in parts[s:e]])
            yield row("places", [i for x in ids[s:e] for i in x], many, *skewed(c.numbers(s, e)), np.concatenate(size[s:e]), np.concatenate(h[s:e]))

    kept, size = [], 0
    for b in blocks(batches, PART):
        x = texts_of(b.column(1))
        kept.append((b.column(0).to_pylist(), Split(x, t), np.diff(x.offsets), x.span_hash(x.offsets[:-1], x.offsets[1:])))
        size += len(x.data)
        if size >= BLOCK:
            base += 1
            yield from rows(kept)
            kept, size = [], 0
    if kept:
        base += 1
        yield from rows(kept)


def join_rows(batches: Iterator[pa.RecordBatch], t: WordTable, made: Callable) -> Iterator[pa.RecordBatch]:
    """What `made` makes of rows (block, ids, data, found): those of a block follow each other, and found, the ranges' answers, is read once for them."""
    now = places = None
    for b in batches:
        for i in range(b.num_rows):
            if (block := b.column("block")[i].as_py()) != now:
                now, places = block, None
                found = sorted(b.column("found")[i].as_py(), key=lambda p: p["idx"])
                (place,), *pieces = (unpack(p["data"]) for p in found)
                word_size, low, high = (np.concatenate([p[k] for p in pieces]).astype(np.int64) if pieces else np.empty(0, np.int64) for k in range(3))
                places = Places(place[:0], np.zeros(1, np.int64), place, low + (high << 8), word_size)
                del found, pieces, low, high, word_size
            many, number, bits, size, h = unpack(b.column("data")[i].as_py())
            places.number, places.before = unskewed(number, bits), np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
            doc_ids, size, h = pa.array(b.column("ids")[i].as_py(), pa.int64()), size.astype(np.int64), h.astype(np.uint64)
            part = (np.cumsum(size) - size) // PART
            for s, e in zip(*(x.tolist() for x in _runs(part)), strict=True):
                yield made(t, doc_ids.slice(s, e - s), size[s:e], h[s:e], *places.ids(s, e))


def encoded(docs: DataFrame, tokenizer: str, scratch: Scratch, made: Callable, schema: str) -> DataFrame:
    """What `made` makes of the rows of docs (doc_id, text), block by block: of the tokenizer's table, ids of
    documents, bytes of texts, their hashes, all ids, and where each text's ids begin."""
    spark = prepared(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    ranges = ranges_for(size)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return split_rows(batches, table(tokenizer), ranges, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32)

    written = docs.select("doc_id", "text").mapInArrow(tidied(split), SPLIT)
    places, words, heads = scratch.write_parts(written, "split", "part", ["places", "words", "heads"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = Block.__new__(Block)
                size, raw, kind, place = unpack(data)
                c.kind, c.place = kind.astype(np.int64), place.astype(np.int64)
                c.words = Texts(raw.astype(np.uint8), np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
                for j, question in c.questions():
                    yield batch_of(ASKED, [block], [j], [question])

    def answer(idx: int, asked: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for who, data in answers(asked, table(tokenizer)):
            yield batch_of(ASKED, [who], [idx], [data])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from join_rows(batches, table(tokenizer), made)

    found = scratch.write(by_range(words.select("block", "data").mapInArrow(tidied(ask), ASKED), answer, ASKED), "answers")
    del words, written
    scratch.drop("split/part=words")
    found = found.union(heads.select(F.col("block").alias("who"), F.lit(HEAD).alias("idx"), "data"))
    found = found.groupBy(F.col("who").alias("block")).agg(F.collect_list(F.struct("idx", "data")).alias("found"))
    return places.join(found, "block", "left").select("block", "ids", "data", "found").mapInArrow(tidied(join), schema)


def encode_ids(docs: DataFrame, tokenizer: str, scratch: Scratch) -> DataFrame:
    """doc_id, n_tokens, ids array<int> and whether they decode to the very text (by length and 64-bit hash), of every row of docs."""

    def made(t: WordTable, doc_id: pa.Array, size: np.ndarray, h: np.ndarray, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        back = texts_of(pa.array([x.decode() for x in t.decode(ids, at)], pa.large_string()))
        same = (np.diff(back.offsets) == size) & (back.span_hash(back.offsets[:-1], back.offsets[1:]) == h)
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(at)), lists, pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])

    return encoded(docs, tokenizer, scratch, made, "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and decoded text of rows (doc_id, ids array<int>); a null list is an empty text."""

    def run(batches):
        t = table(tokenizer)
        for b in batches:
            texts = []
            for ids in b.column(1).to_pylist():
                a = np.array(ids or [], dtype=np.int64)
                texts += t.decode(a, np.array([0, len(a)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode() for x in texts], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def encode_digests(docs: DataFrame, tokenizer: str, scratch: Scratch) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids (unsigned 32-bit, little-endian) and of the decoded text."""

    def made(t: WordTable, doc_id: pa.Array, size: np.ndarray, h: np.ndarray, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        raw, cut = ids.astype("<u4").tobytes(), (at * 4).tolist()
        sha = [hashlib.sha256(raw[a:e]).hexdigest() for a, e in zip(cut[:-1], cut[1:], strict=True)]
        back = [hashlib.sha256(x).hexdigest() for x in t.decode(ids, at)]
        return pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(at)), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return scratch.finish(encoded(docs, tokenizer, scratch, made, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"))
