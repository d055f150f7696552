"""Language identification with word-first backoff.

A known word votes with its frequency in each language. An unseen word falls back to its longest character
n-grams that were seen, five letters first, then four, three, two and one. Each vote is a log posterior over
the languages; a document's votes are summed over all its words and normalised.

The model is fitted on a bounded sample of labelled documents (`sample_rows`, chosen by hashes of the ids), so its tables have a fixed bound; every document is scored over its whole text.

A null text, or one without a letter, gives `und` with score 0. Rows without a label or id are only scored.
Ties go to the alphabetically first language. With no labelled row at all every prediction is `und`.
Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import bounded_sample, held_out, map_slices

#: Labelled documents that the model is fitted on.
SAMPLE_ROWS = 2000
#: Words, and n-grams of each length, that the model keeps: the most frequent ones.
TABLE_ROWS = 60_000
LONGEST = 5
#: Tokens whose votes a worker remembers.
CACHE_ROWS = 400_000
_LETTERS = regex.compile(r"\p{L}+")


def ngrams(word: str, n: int) -> list[str]:
    word = f"^{word}$" if n > 1 else word
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def log_posterior(counts: dict[str, np.ndarray], total: np.ndarray, prior: float = 0.5) -> tuple[dict[str, int], np.ndarray]:
    """Each entry's row, and there log P(language | entry) with equal priors and additive smoothing."""
    if not counts:
        return {}, np.empty((0, len(total)), np.float32)
    keys = list(counts)
    c = np.array([counts[k] for k in keys], dtype=np.float64)
    log_p = np.log(c + prior) - np.log(total + prior * (len(keys) + 1))
    log_p -= np.logaddexp.reduce(log_p, axis=1, keepdims=True)
    return {k: i for i, k in enumerate(keys)}, log_p.astype(np.float32)


class Model:
    def __init__(self, languages: list[str], tables: list[tuple[dict[str, int], np.ndarray]]):
        self.languages, self.tables = languages, tables  # tables[0]: words; tables[n]: n-grams
        self.reset()

    def __getstate__(self):
        return {"languages": self.languages, "tables": self.tables}

    def __setstate__(self, state):
        self.__init__(**state)

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, len(self.languages)), dtype=np.float32)
        self.letters: list[bool] = []

    @classmethod
    def fit(cls, labelled: list[tuple[str, str]]) -> Model:
        languages = sorted({lang for _, lang in labelled})
        at = {lang: i for i, lang in enumerate(languages)}
        words: dict[str, Counter] = {lang: Counter() for lang in languages}
        for text, lang in labelled:
            words[lang].update(_LETTERS.findall(text.lower()))
        tables = []
        for n in range(LONGEST + 1):
            counts: dict[str, np.ndarray] = {}
            for lang, seen in words.items():
                for w, c in seen.items():
                    for g in [w] if n == 0 else ngrams(w, n):
                        if g not in counts:
                            counts[g] = np.zeros(len(languages))
                        counts[g][at[lang]] += c
            total = sum(counts.values(), np.zeros(len(languages)))
            least = 2 if n == 0 else 1
            kept = sorted((k for k, v in counts.items() if v.sum() >= least), key=lambda k: (-counts[k].sum(), k))[:TABLE_ROWS]
            tables.append(log_posterior({k: counts[k] for k in kept}, total))
        return cls(languages, tables)

    def word(self, w: str) -> np.ndarray:
        at, rows = self.tables[0]
        if (i := at.get(w)) is not None:
            return rows[i]
        for n in range(LONGEST, 0, -1):
            at, rows = self.tables[n]
            known = [i for g in ngrams(w, n) if (i := at.get(g)) is not None]
            if known:
                return rows[known].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)

    def learn(self, tokens: set[str]) -> None:
        if len(self.index) + len(tokens) > CACHE_ROWS:
            self.reset()
        for t in tokens:
            if t not in self.index:
                words = _LETTERS.findall(t)
                at = self.index[t] = len(self.letters)
                if at == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                for w in words:
                    self.rows[at] += self.word(w)
                self.letters.append(bool(words))

    def votes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log posterior of each text and language, and whether the text has a letter."""
        cut = [t.lower().split() for t in texts]
        flat = list(chain.from_iterable(cut))
        at = list(map(self.index.get, flat))
        if None in at:
            self.learn({t for t, i in zip(flat, at, strict=True) if i is None})
            at = list(map(self.index.get, flat))
            if None in at:  # the cache was emptied
                self.learn(set(flat))
                at = list(map(self.index.__getitem__, flat))
        rows, at = np.unique(np.array(at, dtype=np.int64), return_inverse=True)
        table = self.rows[rows].astype(np.float64)
        has = np.array([self.letters[r] for r in rows], dtype=bool)
        ends = np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)]).astype(np.int64)
        sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(table[at], axis=0)]) if len(at) else np.zeros((1, len(self.languages)))
        n = np.concatenate([[0], np.cumsum(has[at])]) if len(at) else np.zeros(1, np.int64)
        return sums[ends[1:]] - sums[ends[:-1]], n[ends[1:]] > n[ends[:-1]]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        v, letters = self.votes(texts)
        v -= v.max(axis=1, keepdims=True)
        p = np.exp(v)
        p /= p.sum(axis=1, keepdims=True)
        best = np.where(p >= p.max(axis=1, keepdims=True) - 1e-12, 1, 0).argmax(axis=1)
        score = np.where(letters, p[np.arange(len(texts)), best], 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], score


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, parts: int = 3, remainder: int = 1) -> Model:
    """Fits on about `sample_rows` of the labelled documents that aren't held out, chosen by hashes of their ids."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), parts, remainder))
    rows = bounded_sample(labelled, "doc_id", sample_rows).select("doc_id", "text", "lang").collect()
    return Model.fit([(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.doc_id, r.lang, r.text))])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = model.predict(["" if t is None else t for t in b.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return map_slices(docs.select("doc_id", "text"), run, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, by a model fitted on the rest of `docs`."""
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is known: not `und`, and with a score of at least `least`.

    All columns are passed on as they are.
    """
    model = fit(docs)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = model.predict(["" if t is None else t for t in b.column(b.schema.get_field_index("text")).to_pylist()])
        return b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return map_slices(docs, run, docs.schema)
