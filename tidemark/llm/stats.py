"""Statistics of whole texts that quality scores and quality rules are made of.

Words are runs of bytes outside space and \\x09-\\x0D. A null text counts as empty: all its statistics are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import Texts, map_slices, mix, texts_of

#: Fixed: characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_bytes", "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_marks", "n_bangs", "n_ends"]


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_TABLES = {
    "n_symbols": _class(SYMBOLS),
    "n_upper": _class(bytes(range(65, 91))),
    "n_lower": _class(bytes(range(97, 123))),
    "n_digits": _class(bytes(range(48, 58))),
    "n_marks": _class(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])),
    "n_bangs": _class(b"!"),
    "n_ends": _class(b".?"),
}
_FIRST_BYTE = np.array([b & 0xC0 != 0x80 for b in range(256)])


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def distinct_per_doc(h: np.ndarray, doc: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Distinct hashes of each document; salt holds a number of each document."""
    key = mix(h ^ salt[doc])
    order = np.argsort(key)
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[order][1:] != key[order][:-1]
    return np.bincount(doc[order[new]], minlength=len(salt))


def statistics(t: Texts) -> dict[str, np.ndarray]:
    salt = mix(np.arange(1, t.n + 1, dtype=np.uint64))
    starts, ends, at = t.words()
    n_words = np.diff(at)
    doc = np.repeat(np.arange(t.n), n_words)
    out = {"n_bytes": np.diff(t.offsets), "n_words": n_words}
    first = _FIRST_BYTE[t.data]
    out["n_chars"] = per_doc(first, t.offsets)
    chars = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
    out["word_chars"] = np.bincount(doc, weights=chars[ends] - chars[starts], minlength=t.n).astype(np.int64)
    for name, table in _TABLES.items():
        out[name] = per_doc(table[t.data], t.offsets)
    h = t.span_hash(starts, ends)
    out["n_distinct_words"] = distinct_per_doc(h, doc, salt)
    # windows of three words that occur twice or more in their text
    covered = np.zeros(len(h), dtype=bool)
    if len(h) >= 3:
        whole = doc[2:] == doc[:-2]
        window = mix(h[:-2] * np.uint64(3) + mix(h[1:-1] * np.uint64(5) + mix(h[2:] ^ salt[doc[2:]])))
        where = np.flatnonzero(whole)
        hit = where[repeated(window[where])]
        for k in range(3):
            covered[hit + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=t.n)
    # lines with a word, and those equal to an earlier line
    ls, le = t.runs(t.data != 10)
    with_word = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le = ls[with_word], le[with_word]
    ldoc = t.doc_of(ls)
    n_lines = np.bincount(ldoc, minlength=t.n)
    out["n_lines"] = n_lines
    out["n_dup_lines"] = n_lines - distinct_per_doc(t.span_hash(ls, le), ldoc, salt)
    return out


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the COUNTS (bigint) of every row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = statistics(texts_of(b.column(1)))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[c].astype(np.int64)) for c in COUNTS)], ["doc_id", *COUNTS])

    return map_slices(docs.select("doc_id", "text"), run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))
