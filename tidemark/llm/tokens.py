"""Token counts by prefix dynamic programming.

A text is cut into pieces as the tokenizer's own pre-tokenizer cuts it, and a piece's tokens don't depend on its
neighbours. Inside a piece, a row of tokens is its encoding if every two neighbours are what the merges make of
their own characters. So the encoding of a prefix of i characters ends in the one token t that its neighbour, the
last token of the prefix of i - len(t) characters, tolerates: last[i] and count[i] = count[i - len(t)] + 1 follow
from shorter prefixes, and one pass gives the exact count of every prefix. The token that ends a piece carries the
end mark, so it is looked up apart.

A table has these counts for each distinct piece, running sums over pieces and words take them to the whole text,
and `PrefixCounts` answers "how many tokens has the text's first i characters" and "which is the longest prefix
within a budget" from them without encoding anything again. A text's own count is the last of its prefix counts.

Time and memory are linear in a text and in a word, however long it is; the one exception is a letter followed by
marks that compose with it, whose word is gone over once more for each such mark.

Nulls are empty texts with 0 tokens; repeated rows are counted each for itself; other columns of the input
are ignored. Texts of any length are counted whole, in about 20 times their bytes of memory; an empty table gives
an empty result.
"""

from __future__ import annotations

import bisect
import json
import os
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import byte_level, map_slices

#: Distinct words (and as many pieces) whose counts a worker keeps; beyond that it starts a new table.
TABLE_LIMIT = 600_000
#: Fixed: the pre-tokenizer's pattern, as in the vocabulary file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Fixed: runs without Unicode white space, which no piece of the pattern crosses.
BETWEEN_SPACES = regex.compile("[^\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: Fixed: the pattern's pieces of an apostrophe and two letters.
CONTRACTIONS = {"'re", "'ve", "'ll"}


def _joins(c: str) -> bool:
    """Whether a character may compose with what is before it: marks, and parts of Korean and Kirat Rai syllables."""
    return unicodedata.category(c)[0] == "M" or 0x1160 <= ord(c) <= 0x11FF or 0x16D60 <= ord(c) <= 0x16D7F


class Prefixes:
    """Exact token counts of all prefixes of byte-level pieces, for a BPE model with an end mark."""

    def __init__(self, model: dict):
        self.mark = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        n = len(self.mark)
        ends = {t[: len(t) - n] for t in model["vocab"] if n and t.endswith(self.mark) and len(t) > n}
        inner = {t for t in model["vocab"] if not (n and t.endswith(self.mark))}
        #: tokens inside and at the end of a piece (without the mark), and all that they end in
        self.inner, self.ends = inner, ends if n else inner
        self.inner_tails, self.end_tails = ({t[k:] for t in x for k in range(len(t))} for x in (self.inner, self.ends))
        self.tolerated: dict[tuple[str | None, str, bool], bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """What the merges make of some symbols: always the pair that comes first in the list, leftmost first."""
        symbols, get = list(symbols), self.rank.get
        none = len(self.rank)
        ranks = [get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), none)
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
        return symbols

    def fits(self, before: str | None, token: str, last: bool) -> bool:
        """Whether a token may stand after `before` (None: first) in an encoding."""
        known = self.tolerated.get((before, token, last))
        if known is None:
            if len(self.tolerated) > TABLE_LIMIT:
                self.tolerated.clear()
            mark = self.mark if last else ""
            want = [*([before] if before else []), token + mark]
            symbols = list((before or "") + token)
            symbols[-1] += mark
            known = self.tolerated[before, token, last] = self.merged(symbols) == want
        return known

    def counts(self, piece: str) -> array:
        """Tokens of piece[:i] as a piece of its own, for each i."""
        return next(self.all_counts([piece]))

    def all_counts(self, pieces: Iterable[str]) -> Iterator[array]:
        """The counts of some pieces. What a piece has in common with the one before it isn't gone over again, so
        sorted pieces are quick."""
        last: list[str | None] = [None]  # the last token of each prefix, not at a piece's end
        inside, out, done = [0], array("i", [0]), ""
        inner, inner_tails, ends, end_tails, fits = self.inner, self.inner_tails, self.ends, self.end_tails, self.fits
        known = self.tolerated
        for piece in pieces:
            same = len(commonprefix((done, piece)))
            del last[same + 1 :], inside[same + 1 :], out[same + 1 :]
            for i in range(same + 1, len(piece) + 1):
                j = i - 1
                found = []
                while j >= 0 and (t := piece[j:i]) in inner_tails:
                    if t in inner:
                        found.append((j, t))
                    j -= 1
                while True:
                    j, t = found.pop()
                    ok = known.get((last[j], t, False))
                    if fits(last[j], t, False) if ok is None else ok:
                        break
                token, total = t, inside[j] + 1
                j = i - 1
                found = []
                while j >= 0 and (t := piece[j:i]) in end_tails:
                    if t in ends:
                        found.append((j, t))
                    j -= 1
                while True:
                    j, t = found.pop()
                    ok = known.get((last[j], t, True))
                    if fits(last[j], t, True) if ok is None else ok:
                        break
                out.append(inside[j] + 1)
                last.append(token)
                inside.append(total)
            done = piece
            yield out[:]


class PieceCounter:
    """Counts tokens of pieces and texts for one tokenizer file of the word-end BPE kind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            self.prefixes = Prefixes(json.load(f)["model"])
        specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) or r"(?!)")
        self.pieces = regex.compile(PIECES)
        #: Characters (not NUL, which marks other forms) for which NFC, white space and lower-casing here and in the library surely agree.
        self.plain = regex.compile("[\x01-\x1b\x20-\u012f\u0131-\u024f]*")
        self.table: dict[str, int] = {}
        self.piece_table: dict[str, array] = {}
        self.prefix_table: dict[str, array] = {}

    def split(self, text: str) -> list[str]:
        """The words of a text that holds no special token's string. No piece crosses white space."""
        if self.plain.fullmatch(text):
            return text.lower().split()
        cut = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))
        return ["\0" + p for p, _ in cut]  # byte-level form; \0 keeps it apart from plain words

    def piece(self, p: str) -> array:
        """Counts of all prefixes of a piece in byte-level characters, worked out once for each distinct piece."""
        known = self.piece_table.get(p)
        if known is None:
            known = self.piece_table[p] = self.prefixes.counts(p)
        return known

    def of_prefixes(self, text: str) -> array:
        """Tokens of text[:i] for each i, for a normalised text without white space."""
        out = array("i", [0] * (len(text) + 1))
        total, done = 0, 0
        for _, (start, end) in self.tok.pre_tokenizer.pre_tokenize_str(text):
            out[done + 1 : start + 1] = array("i", [total] * (start - done))
            chars = text[start:end]
            counts, at = self.piece(byte_level(chars)), 0
            for k, ch in enumerate(chars, start + 1):
                at += len(ch.encode())
                out[k] = total + counts[at]
            if len(chars) == 3 and chars in CONTRACTIONS:  # its first two characters are two pieces
                out[start + 2] = total + self.piece(chars[0])[-1] + self.piece(chars[1])[-1]
            total, done = out[end], end
        out[done + 1 :] = array("i", [total] * (len(text) - done))
        return out

    def word_prefixes(self, word: str) -> array:
        """Tokens of word[:i] for each i, for a word of a text as it is, without white space."""
        known = self.prefix_table.get(word)
        if known is None:
            if len(self.prefix_table) > TABLE_LIMIT:
                self.prefix_table.clear()
            known = self.prefix_table[word] = self._word_prefixes(word)
        return known

    def _word_prefixes(self, word: str) -> array:
        if self.plain.fullmatch(word):
            return self.of_prefixes(word.lower())
        normal = self.tok.normalizer.normalize_str
        # characters that never compose with what is before them begin a group; groups are normalised one by one
        begins = [0, *(i for i, c in enumerate(word) if i and not _joins(c)), len(word)]
        parts = [normal(word[a:b]) for a, b in zip(begins, begins[1:], strict=False)]
        whole = "".join(parts)
        counts, out, at = self.of_prefixes(whole), array("i", [0]), 0
        for a, b, part in zip(begins, begins[1:], parts, strict=False):
            for i in range(a + 1, b):
                head = normal(word[a:i])
                out.append(counts[at + len(head)] if part.startswith(head) else self.of_prefixes(whole[:at] + head)[-1])
            at += len(part)
            out.append(counts[at])
        return out

    def learn(self, words: set[str]) -> None:
        """Counts each word that isn't in the table, once: the sum over its pieces."""
        if len(self.table) + len(words) > TABLE_LIMIT:
            self.table.clear()
        if len(self.piece_table) > TABLE_LIMIT:
            self.piece_table.clear()
        cut = {w: [w[1:]] if w[0] == "\0" else [p if p.isascii() else byte_level(p) for p in self.pieces.findall(w)] for w in words if w not in self.table}
        new = sorted({p for pieces in cut.values() for p in pieces if p not in self.piece_table})
        self.piece_table.update(zip(new, self.prefixes.all_counts(new), strict=True))
        for w, pieces in cut.items():
            self.table[w] = sum(self.piece_table[p][-1] for p in pieces)

    def parts(self, text: str) -> list[str | None]:
        """The words; None stands for one special token."""
        if "<|" not in text or not self.special.search(text):
            return self.split(text)
        out: list[str | None] = []
        at = 0
        for m in self.special.finditer(text):
            out += self.split(text[at : m.start()])
            out.append(None)
            at = m.end()
        return out + self.split(text[at:])

    def totals(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text: the last value of its prefix counts."""
        cut = [self.parts(t) for t in texts]
        flat: list = list(chain.from_iterable(cut))
        get = self.table.get
        counts = list(map(get, flat))
        if None in counts:
            self.learn({w for w, n in zip(flat, counts, strict=True) if n is None and w is not None})
            get = self.table.get
            counts = [1 if w is None else get(w) for w in flat]
            if None in counts:  # the table was started anew
                self.learn({w for w in flat if w is not None})
                counts = [1 if w is None else self.table[w] for w in flat]
        prefix = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])
        ends = np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)]).astype(np.int64)
        return prefix[ends[1:]] - prefix[ends[:-1]]


class PrefixCounts:
    """Exact token counts of every prefix of one text.

    sums[j] holds the tokens up to the end of word j; a table has those of each distinct word's prefixes.
    """

    def __init__(self, counter: PieceCounter, text: str):
        self.counter, self.text = counter, text
        self.starts, self.ends, counts = [0], [0], [0]
        self.special: set[int] = set()
        at = 0
        for m in [*counter.special.finditer(text), None]:
            for w in BETWEEN_SPACES.finditer(text, at, m.start() if m else len(text)):
                self.starts.append(w.start())
                self.ends.append(w.end())
                counts.append(counter.word_prefixes(w.group())[-1])
            if m:
                self.special.add(len(self.starts))
                self.starts.append(m.start())
                self.ends.append(m.end())
                counts.append(1)
                at = m.end()
        self.sums = np.cumsum(counts)

    def count(self, i: int) -> int:
        """Tokens of text[:i]."""
        j = bisect.bisect_right(self.ends, i) - 1
        if j + 1 >= len(self.starts) or self.starts[j + 1] >= i:
            return int(self.sums[j])
        base, inside = self._inside(j + 1)
        return base + inside[i - self.starts[j + 1]]

    def _inside(self, j: int) -> tuple[int, array]:
        """Counts of the prefixes of word j, and what is to be added. A special token that is cut is none: its
        characters go on from the word that it touches."""
        k = j
        while j in self.special and k > 1 and self.ends[k - 1] == self.starts[k] and k - 1 not in self.special:
            k -= 1
        counts = self.counter.word_prefixes(self.text[self.starts[k] : self.ends[j]])
        return int(self.sums[k - 1]), counts[self.starts[j] - self.starts[k] :]

    def cut(self, budget: int) -> int:
        """The longest prefix, in characters, that has at most `budget` tokens.

        Whole words are found by bisection; in the first word that doesn't fit every prefix is looked at, as
        counts inside a word may fall again.
        """
        j = int(np.searchsorted(self.sums, budget, side="right")) - 1
        if j + 1 >= len(self.starts):
            return len(self.text)
        base, inside = self._inside(j + 1)
        return self.starts[j + 1] + max((i for i, n in enumerate(inside[:-1]) if base + n <= budget), default=0)


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PieceCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs (doc_id, text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = ["" if t is None else t for t in b.column(1).to_pylist()]
        n = counter(tokenizer).totals(texts)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["doc_id", "n_tokens"]).append_column("n_bytes", pa.array([len(t.encode()) for t in texts], pa.int64()))

    out = map_slices(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, n_bytes bigint")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def truncate_texts(docs: DataFrame, tokenizer: str, budget: int) -> DataFrame:
    """doc_id and the longest prefix of the text that has at most `budget` tokens."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(tokenizer)
        texts = ["" if t is None else t for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([t[: PrefixCounts(c, t).cut(budget)] for t in texts], pa.string())], ["doc_id", "text"])

    return map_slices(docs.select("doc_id", "text"), run, "doc_id bigint, text string")
