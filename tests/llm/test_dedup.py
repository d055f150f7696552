"""op3, op4 and op7: against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidemark.llm import components, decontam, neardup, suffix
from tidemark.llm.text import Scratch, texts_of


# --- components


@pytest.mark.parametrize("shape", ["path", "star", "mixed", "none"])
def test_components(spark, scratch, shape):
    rnd = random.Random(4)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(40)], "none": [], "mixed": [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(3, 3), (None, 4)]}[shape]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(parent) if find(x) != x}
    got = components.connected(spark.createDataFrame(edges, "a bigint, b bigint"), scratch, "c")
    assert {r.node: r.component for r in got.collect()} == want


# --- near-duplicates


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates(spark, scratch):
    """A cloud of edited copies around the threshold, a large group of exact copies, and short texts."""
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(9999)}" for _ in range(200)]
    rows = []
    for i in range(150):
        x = list(base)
        for _ in range(rnd.randrange(14)):
            x[rnd.randrange(200)] = f"z{rnd.randrange(9999)}"
        rows.append((i * 7 % 1009, "  ".join(x)))
    rows += [(2000 + i, " ".join(base[:60])) for i in range(90)]
    rows += [(5000, ""), (5001, None), (5002, "a b"), (5003, "A\tb"), (5004, "a b c d e"), (5005, "a B c d e\n"), (5006, "a b c d e f")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == linked(rows)
    assert len(got) == len(rows)


def test_large_buckets_in_blocks(spark, scratch, monkeypatch):
    """With blocks of a few members and no star rounds, every pair still meets."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "STAR_ROUNDS", 1)
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(9999)}" for _ in range(150)]
    rows = []
    for i in range(60):
        x = list(base)
        for _ in range(rnd.randrange(12)):
            x[rnd.randrange(150)] = f"z{rnd.randrange(9999)}"
        rows.append((i, " ".join(x)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == linked(rows)


def test_near_duplicates_of_odd_texts(odd, empty, spark, scratch):
    got = neardup.near_duplicates(odd, scratch).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[8].component_id == by[9].component_id == 8 and not by[9].kept
    assert by[1].n_shingles == by[2].n_shingles == 0 and by[1].kept
    assert len([r for r in got if r.doc_id == 4]) == 1  # a document is a doc_id
    assert sum(r.doc_id is None for r in got) == 2
    assert neardup.near_duplicates(empty, Scratch(spark, "t")).count() == 0
    kept = neardup.keep_one(odd, Scratch(spark, "t"))
    assert kept.columns == odd.columns and kept.filter("doc_id in (4, 8, 9)").count() == 2


# --- suffix arrays


def brute(rows, width=200):
    c = Counter(b[p : p + width] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - width + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if c[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(gone[q] and (q == 0 or not gone[q - 1]) for q in range(len(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def planted():
    rnd = random.Random(5)
    junk = lambda n: "".join(rnd.choice("abcdefgh é\n") for _ in range(n))
    p1, p2, p3 = junk(150), junk(210), junk(900)
    rows = [(i, junk(rnd.randrange(700)) + rnd.choice([p1, p2, p3, p3[100:500], p2 + p1, ""]) + junk(rnd.randrange(300))) for i in range(60)]
    rows += [(500, "x" * 1000), (501, "ab" * 700), (502, None), (502, None), (503, ""), (504, junk(199)), (505, p3), (505, p3), (506, junk(300) * 3), (None, p2[:200]), (None, junk(300))]
    return rows + [(507, "x" * 250), (508, ("\0" * 30 + "q") * 20), (509, "x" * 200 + "yy"), (510, "zz" + "x" * 203 + junk(20)), (511, "x" * 900 + junk(300)), (512, ("ab" * 150)[1:])]


@pytest.mark.parametrize("limit", [20_000, 1])
def test_removed_bytes(spark, scratch, monkeypatch, limit):
    monkeypatch.setattr(suffix, "GROUP_LIMIT", limit)
    rows = planted()
    got = suffix.digests(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_suffix_of_odd_texts(odd, empty, odd_rows, spark, scratch):
    got = suffix.digests(odd, scratch).collect()
    short = [(i, t) for i, t, _, _ in odd_rows if t is None or len(t) < 5000]
    want = dict(Counter(r[:4] for r in brute(short)))
    assert dict(Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got if r.doc_id != 4)) == want
    assert all(r.n_removed == r.n_bytes for r in got if r.doc_id == 4)
    assert suffix.digests(empty, Scratch(spark, "t")).count() == 0
    cut = suffix.remove_repeats(odd, Scratch(spark, "t"))
    assert cut.schema == odd.schema and cut.count() == odd.count()
    assert cut.filter("text is null").count() == odd.filter("text is null").count()


def test_interval_tree_finds_maximal_repeats():
    rnd = random.Random(2)
    for _ in range(60):
        data = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randrange(6, 30))) for _ in range(rnd.randrange(1, 6))]
        end = np.cumsum([len(x) for x in data])
        begin = end - [len(x) for x in data]
        s = suffix.SuffixArray(np.frombuffer(b"".join(data), np.uint8), begin, end, np.array([len(x) for x in data]))
        got = set()
        for n, i, j in s.maximal_repeats(3):
            where = frozenset((int(s.owner[p]), int(p - begin[s.owner[p]])) for p in s.sa[i:j])
            text = {data[o][p : p + n] for o, p in where}
            assert len(text) == 1
            got.add((text.pop(), where))
        places = {}
        for o, x in enumerate(data):
            for p in range(len(x)):
                for q in range(p + 3, len(x) + 1):
                    places.setdefault(x[p:q], set()).add((o, p))
        want = set()
        for text, where in places.items():
            left = {data[o][p - 1] if p else (o, p) for o, p in where}
            right = {data[o][p + len(text)] if p + len(text) < len(data[o]) else (o, p) for o, p in where}
            if len(where) > 1 and len(left) > 1 and len(right) > 1:
                want.add((text, frozenset(where)))
        assert got == want


# --- decontamination


def closest(item, words):
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(words):
            new.append(min(row[j + 1] + 1, row[j] + (x != y), new[j] + 1))
        row = new
    return min(row)


def test_leaks_against_every_window():
    rnd = random.Random(1)
    voc = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(voc) for _ in range(rnd.randrange(5, 50)))) for i in range(25)]
    docs: list = ["", None]
    for _ in range(150):
        w = [rnd.choice(voc) for _ in range(rnd.randrange(100))]
        it = rnd.choice(items)[1].split()
        for _ in range(rnd.randrange(int(len(it) * 0.3) + 1)):
            q, z = rnd.randrange(len(it)), rnd.random()
            if z < 0.4:
                it[q] = "edit"
            elif z < 0.7 and len(it) > 3:
                del it[q]
            else:
                it.insert(q, "new")
        at = rnd.randrange(len(w) + 1)
        docs.append(" ".join(w[:at]) + " " + ", ".join(it).upper() + ". " + " ".join(w[at:]))
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    found = decontam.Items([i for i, _ in items], [x for _, x in items]).search(texts_of(pa.array(docs, pa.large_string()), lower=True))
    got = {(int(d), int(i)): int(e) for d, i, e in zip(*found, strict=True)}
    want = {}
    for d, x in enumerate(docs):
        for i, y in items:
            a = split(y)
            if (e := closest(a, split(x))) <= decontam.budget(len(a)):
                want[d, i] = e
    assert len(set(want) - set(got)) <= 0.01 * len(want)
    assert not set(got) - set(want)


def test_short_items_match_exactly():
    items = ["one", "two words", "a b c d e f g", "of a document's end"]
    docs = ["ONE", "some two, words", "two", "words two", "x a b c d e f g y", "a b c d e f h", "the end of a document", "s end", "nothing"]
    found = decontam.Items([10, 11, 12, 13], items).search(texts_of(pa.array(docs, pa.large_string()), lower=True))
    assert {(int(d), int(i), int(e)) for d, i, e in zip(*found, strict=True)} == {(0, 0, 0), (1, 1, 0), (4, 2, 0)}


def test_common_words_make_few_candidates():
    """Items and documents of a few very frequent words: samples that stay on one word aren't in the index."""
    rnd = random.Random(2)
    words = ["the", "of", "and", "to"]
    text = lambda n: " ".join(rnd.choice(words) if rnd.random() < 0.7 else f"w{rnd.randrange(3000)}" for _ in range(n))
    items = [text(30) for _ in range(100)]
    it = decontam.Items(list(range(100)), items)
    t = texts_of(pa.array([text(3000), items[3] + " " + text(500)], pa.large_string()), lower=True)
    h, _ = decontam.word_hashes(t)
    hits = sum(len(p) for k, key in decontam.sample_keys(h) for p, _, _ in it.tables[k].hits(key))
    assert hits < 200 * len(h)
    assert (1, 3, 0) in set(zip(*(x.tolist() for x in it.search(t)), strict=True))


def test_leaks_of_odd_texts(odd, empty, spark, monkeypatch):
    rnd = random.Random(9)
    item = prose(rnd, 20)
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(90, "before " + item + " after"), (91, item), (91, item)], "doc_id bigint, text string"))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "not in there")], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id, r.edits) for r in decontam.leaks(docs, bench).collect()) == [(90, 1, 0)] * 2 + [(91, 1, 0)] * 4
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1)  # one item a pass
    assert decontam.keep_clean(docs, bench).filter("doc_id in (90, 91)").count() == 0
    assert decontam.keep_clean(docs, bench).count() == docs.count() - 3


def test_null_ids_whose_short_hashes_are_equal(spark):
    """Two documents without an id whose 32-bit hashes collide stay two documents."""
    rnd = random.Random(11)
    texts = spark.range(500_000).selectExpr("concat('text of number ', id) AS t").selectExpr("t", "hash(t) AS h")
    pair = texts.groupBy("h").agg(F.sort_array(F.collect_set("t")).alias("t")).filter("size(t) > 1").orderBy("h").first().t
    long = prose(rnd, 60)
    rows = [(None, pair[0]), (None, pair[1]), (None, long), (None, long + " more"), (7, long), (7, "other " + long)]
    got = suffix.digests(spark.createDataFrame(rows, "doc_id bigint, text string"), Scratch(spark, "t")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_clashing_columns_come_through(odd, spark):
    names = [c for c in odd.columns if c not in ("doc_id", "text")]
    df = odd.select("doc_id", "text", *[F.lit(7 if i % 2 else "x").alias(c) for i, c in enumerate(names)])
    for out in (neardup.keep_one(df, Scratch(spark, "t")), suffix.remove_repeats(df, Scratch(spark, "t"))):
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(r[c] == (7 if i % 2 else "x") for r in got for i, c in enumerate(names))
