"""op5 and op8: against the library itself."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tidemark.llm import bpe, exchange, text, tokens  # noqa: E402
from tidemark.llm.text import Scratch  # noqa: E402

TEXTS = ["", "a<|endoftext|>b <|startoftext|>'s", "ΑΣ Σίσυφος İstanbul é ​ x　y 中文 ①½ x²  \n\n  y\x1cz\x85q", "it's we'll 'RE  'Ll ... ''s", "ȩ́́ ﬁ Å ퟿ \U0001f600 ٠٣  a b", " lead and trail  ", "\0\0 nul\0s"]


@pytest.fixture(scope="module")
def word():
    return P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte():
    return P.path("byte_bpe_50k.json")


def test_counts_equal_the_library(word, odd_rows):
    texts = TEXTS + [r[1] or "" for r in odd_rows]
    lib = Tokenizer.from_file(str(word))
    assert tokens.PieceCounter(str(word)).totals(texts).tolist() == [len(e) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix(word):
    c, lib = tokens.PieceCounter(str(word)), Tokenizer.from_file(str(word))
    for t in TEXTS:
        p = tokens.PrefixCounts(c, t)
        assert [p.count(i) for i in range(len(t) + 1)] == [len(lib.encode(t[:i], add_special_tokens=False)) for i in range(len(t) + 1)]


@pytest.mark.parametrize("text", ["wow!<|endoftext|>!", "a<|endoftext|><|startoftext|>b", "x's!'re'llama 'vex", "e\u0301e\u0301\u0323 na\u0308ive \u1100\u1161\u11a8", "\u0939\u093f\u0928\u094d\u0926\u0940\u0e2a\u0e27\u0e31"])
def test_every_prefix_of_odd_words(word, text):
    c, lib = tokens.PieceCounter(str(word)), Tokenizer.from_file(str(word))
    p = tokens.PrefixCounts(c, text)
    assert [p.count(i) for i in range(len(text) + 1)] == [len(lib.encode(text[:i], add_special_tokens=False)) for i in range(len(text) + 1)]


def test_long_words_take_linear_time(word):
    """100,000 characters without white space, of letters and digits, and in a script without spaces."""
    import time

    c, lib = tokens.PieceCounter(str(word)), Tokenizer.from_file(str(word))
    for text in ("abcXYZ19" * 12_500, "\u4e2d\u6587\u5b57\u4e00" * 25_000):
        began = time.process_time()
        p = tokens.PrefixCounts(c, text)
        cut = p.cut(5000)
        assert time.process_time() - began < 20
        assert p.count(len(text)) == len(lib.encode(text, add_special_tokens=False))
        assert len(lib.encode(text[:cut], add_special_tokens=False)) <= 5000


def test_truncated_texts(spark, odd, odd_rows, word):
    lib = Tokenizer.from_file(str(word))
    got = tokens.truncate_texts(odd, str(word), 12).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert len(lib.encode(r.text, add_special_tokens=False)) <= 12


def test_op5_over_the_smallest_table(spark, data):
    from tidemark.llm import queries

    lib = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.op5_token_counts(spark, data).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {i: (len(t.encode()), len(lib.encode(t, add_special_tokens=False))) for i, t in docs.items()}


def test_cut_fits_the_budget(word):
    c = tokens.PieceCounter(str(word))
    text = "some words, don't you think? " * 5
    for budget in (0, 1, 7, 20, 1000):
        cut = tokens.PrefixCounts(c, text).cut(budget)
        assert len(c.tok.encode(text[:cut], add_special_tokens=False)) <= budget
        assert cut == len(text) or len(c.tok.encode(text[: cut + 1], add_special_tokens=False)) > budget


def test_table_limit_changes_nothing(word, monkeypatch):
    texts = TEXTS * 3
    want = tokens.PieceCounter(str(word)).totals(texts).tolist()
    monkeypatch.setattr(tokens, "TABLE_LIMIT", 3)
    assert tokens.PieceCounter(str(word)).totals(texts).tolist() == want


def test_count_tokens_rows(odd, empty, odd_rows, word):
    got = tokens.count_tokens(odd, str(word), limit=10).collect()
    lib = Tokenizer.from_file(str(word))
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False)), n > 10) for i, t, _, _ in odd_rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.count_tokens(empty, str(word)).count() == 0


def test_encode_and_decode_equal_the_library(byte, odd_rows):
    texts = TEXTS + [r[1] or "" for r in odd_rows]
    lib, t = Tokenizer.from_file(str(byte)), bpe.WordTable(str(byte))
    ids, at = t.encode(texts)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    assert [x.decode() for x in t.decode(ids, at)] == [lib.decode(w, skip_special_tokens=False) for w in want]


def test_small_tables_change_nothing(byte, monkeypatch):
    t = bpe.WordTable(str(byte))
    want = t.encode(TEXTS)[0].tolist()
    monkeypatch.setattr(bpe, "TABLE_LIMIT", 2)
    small = bpe.WordTable(str(byte))
    assert small.encode(TEXTS)[0].tolist() == want and small.encode(TEXTS)[0].tolist() == want


def test_numbers_come_back():
    from tidemark.llm.exchange import pack, skewed, unpack, unskewed

    rnd = np.random.default_rng(1)
    for x in (np.empty(0, np.int64), np.zeros(3, np.int64), np.array([255, 256, 2**40, 0, 1]), np.floor(2 ** (20 * rnd.random(5000))).astype(np.int64)):
        assert unskewed(*unpack(pack(*skewed(x)))).tolist() == x.tolist()
        assert unpack(pack(x, x[::-1]))[0].tolist() == x.tolist()


def test_words_are_encoded_once(byte, monkeypatch):
    """Two blocks that ask for the same words: each is encoded once, and both get its ids."""
    import pyarrow as pa

    from tidemark.llm.exchange import unpack
    from tidemark.llm.text import texts_of

    t = bpe.WordTable(str(byte))
    seen, real = [], t.ids_of
    monkeypatch.setattr(t, "ids_of", lambda kind, word: (seen.append((kind, word)), real(kind, word))[1])
    texts = [TEXTS, TEXTS[::-1] + ["more words"]]
    cut = [bpe.Block([bpe.Split(texts_of(pa.array(x[s : s + 2], pa.large_string())), t) for s in range(0, len(x), 2)]) for x in texts]
    asked = [(i, d) for i, c in enumerate(cut) for _, d in c.questions()]
    got = dict(bpe.answers(asked, t))
    assert len(seen) == len(set(seen))
    for i, c in enumerate(cut):
        ids, at = t.encode(texts[i])
        size, low, high = (x.astype(np.int64) for x in unpack(got[i]))
        p = bpe.Places(c.number, c.before, c.place, low + (high << 8), size)
        for s, e in ((0, len(texts[i])), (2, 5)):
            own, begin = p.ids(s, e)
            assert own.tolist() == ids[at[s] : at[e]].tolist() and begin.tolist() == (at[s : e + 1] - at[s]).tolist()


def test_blocks_are_joined_row_by_row(byte, monkeypatch):
    """A block's texts are many rows of some bytes, in the splitting as in the joining, and its words one table all the same."""
    for name, size in (("BLOCK", 1 << 16), ("ROW", 1 << 13), ("PART", 1 << 11)):
        monkeypatch.setattr(bpe, name, size)
    rnd = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rnd.integers(0, 300, n)) for n in rnd.integers(0, 150, 300)] + ["a b" * 9000, *TEXTS]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(s, min(s + 50, len(texts)))), pa.array(texts[s : s + 50], pa.string())], ["doc_id", "text"]) for s in range(0, len(texts), 50)]
    t = bpe.WordTable(str(byte))
    rows = [r for b in bpe.split_rows(iter(batches), t, 1, 7) for r in b.to_pylist()]
    of = {k: {b: [r for r in rows if r["part"] == k and r["block"] == b] for b in (8, 9, 10)} for k in ("places", "words", "heads")}
    assert len(rows) == sum(len(x) for k in of.values() for x in k.values())
    many = [len(x) for x in of["places"].values()]
    assert many[0] > 4 and sum(many) > 8 and all(len(x) == 1 for k in ("words", "heads") for x in of[k].values() if x)
    assert max(sum(len(texts[i].encode()) for i in r["ids"]) for x in of["places"].values() for r in x if 300 not in r["ids"]) < 2 << 13
    asked = []
    for b, (w, *_) in ((b, x) for b, x in of["words"].items() if x):
        size, raw, kind, _ = exchange.unpack(w["data"])
        asked.append((b, exchange.pack(size, raw, kind)))
    found = dict(bpe.answers(asked, t))
    kinds = pa.list_(pa.struct([("idx", pa.int32()), ("data", pa.binary())]))
    joined = [pa.RecordBatch.from_arrays([pa.array([b]), pa.array([r["ids"]]), pa.array([r["data"]], pa.binary()), pa.array([[{"idx": 0, "data": found[b]}, {"idx": bpe.HEAD, "data": of["heads"][b][0]["data"]}]], kinds)], ["block", "ids", "data", "found"]) for b, x in of["places"].items() for r in x[::-1]]
    got = {}
    for doc_id, size, _, ids, at in bpe.join_rows(iter(joined), t, lambda _, *x: x):
        assert size.tolist() == [len(texts[i].encode()) for i in doc_id.to_pylist()]
        got |= {i: ids[s:e].tolist() for i, s, e in zip(doc_id.to_pylist(), at[:-1], at[1:], strict=True)}
    ids, at = t.encode(texts)
    assert got == {i: ids[s:e].tolist() for i, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True))}


def test_splitting_holds_a_row_not_a_block(byte):
    """What numpy takes for a block is that of a part and a row; it was some 7 bytes for each of the block's, and more with the texts."""
    rnd = np.random.default_rng(1)
    words = [f"w{i}" for i in range(5000)]
    batches = [pa.RecordBatch.from_arrays([pa.array([s]), pa.array([" ".join(words[i] for i in rnd.integers(0, 5000, 160_000))])], ["doc_id", "text"]) for s in range(24)]
    t, peaks = bpe.WordTable(str(byte)), []
    for n in (1, 8, 24):  # the first one makes tables of powers and the like
        tracemalloc.start()
        assert sum(r["part"] == "heads" for b in bpe.split_rows(iter(batches[:n]), t, 64, 0) for r in b.to_pylist()) == 1
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[2] < 1.3 * peaks[1]


def test_op8_over_the_smallest_table(spark, data):
    from tidemark.llm import queries

    lib = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    got = {r.doc_id: r for r in queries.op8_bpe(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_digests_and_round_trip(odd, empty, odd_rows, byte, spark):
    lib = Tokenizer.from_file(str(byte))
    want = []
    for i, t, _, _ in odd_rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.encode_digests(odd, str(byte), Scratch(spark, "t"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    both = bpe.encode_ids(odd, str(byte), Scratch(spark, "t"))
    assert both.filter("NOT round_trip").count() == 0
    back = bpe.decode_ids(both, str(byte)).filter("doc_id = 6").first().text
    assert back == odd_rows[8][1]
    assert bpe.encode_digests(empty, str(byte), Scratch(spark, "t")).count() == 0


def test_numbers_are_packed_a_few_at_a_time():
    """The bits of a large block's numbers aren't spread out all at once: that took 80 bytes a number and more."""
    x = np.random.default_rng(1).integers(0, 1 << 16, 500_003)
    x[:1000] = np.arange(1000)
    tracemalloc.start()
    size, bits = exchange.skewed(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * len(x)
    assert (exchange.unskewed(size, bits) == x).all()


def test_workers_give_memory_back(spark):
    """A worker that is used again doesn't hold what its last task has freed."""

    def held(b):
        at = [x for x in open("/proc/self/status") if x.startswith("RssAnon")]
        some = [np.ones(1250) for _ in range(30_000)]  # pieces that malloc keeps: the last one stays
        np.last_piece = some[-1]
        return pa.RecordBatch.from_arrays([pa.array([int(at[0].split()[1]) // 1024] * b.num_rows)], ["mb"])

    docs = spark.createDataFrame([("x",)], "text string").repartition(1)
    first, *others = [text.map_slices(docs, held, "mb bigint").collect()[0].mb for _ in range(6)]
    assert max(others) < first + 150
