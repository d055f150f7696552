"""op6 and op10, and the pipeline as a whole."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.conftest import prose
from tests.test_queries import rows
from tidemark.llm import exchange, lm, queries, urls
from tidemark.llm.text import Scratch, texts_of


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check_base(got, docs):
    c, ends = Counter(), 0
    for i, t in docs:
        if not held(i):
            c.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    want = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        want.append((i, held(i), len(w) + 1, sum(x in c for x in w) + (ends > 0), n, round(base, 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)


def test_scores(odd, odd_rows, empty, spark, scratch):
    got = lm.score_documents(odd, scratch).collect()
    check_base(got, [r[:2] for r in odd_rows])
    assert all(r.score < 0 for r in got)
    assert lm.score_documents(empty, Scratch(spark, "t")).count() == 0


class Memory:
    """The whole model of some texts in memory: blocks of texts, one range of units, one of contexts."""

    def __init__(self, blocks, held, kinds=None):
        self.texts = [texts_of(pa.array(b, pa.large_string())) for b in blocks]
        self.held = [np.array(h) for h in held]
        seen = np.zeros(256)
        for t, h in zip(self.texts, self.held, strict=True):
            seen += np.bincount(t.data[np.repeat(~h, np.diff(t.offsets))], minlength=256)
            seen[lm.END] += (~h).sum()
        self.tree, self.cuts, asked = lm.Tree(seen), [], []
        for i, (t, h) in enumerate(zip(self.texts, self.held, strict=True)):
            c = lm.Cut.read(lm.Cut(t).packed())
            c.entries(np.zeros(t.n, np.int64) if kinds is None else np.array(kinds[i]), ~h)
            self.cuts.append(c)
            asked += [(i, d) for _, d in lm.unit_questions(c, ~h, 1)]
        data, self.back, self.distinct, self.occurrences = lm.merged_units(asked)
        u = self.units = lm.Units(data, self.tree, 50)
        ask = [(0, d) for _, d in lm.pair_questions(u.keys, u.n, 50, 1)]
        u.answered(*lm.read_answers([{"idx": 0, "data": d} for _, d in lm.pair_answers(ask, self.tree)]))
        self.weights = lm.joined(lm.regression(u))

    def answers(self, i):
        sure, many, z = self.units.mixed(self.weights)
        at = np.concatenate([[0], np.cumsum(many)])
        e = exchange.unpack(dict(self.back)[i])[0].astype(np.int64)
        return lm.Answers(sure[e], many[e], z[exchange.ragged(at[e], many[e])[0]])

    def bits(self, i):
        return lm.score(self.cuts[i], self.answers(i), np.zeros(self.texts[i].n))


def test_score_is_a_probability():
    """Over all one-byte texts and many longer ones the probabilities of an ended text sum up to 1 at most, and not to little."""
    asked = ["", *map(chr, range(128)), *(a + b for a in map(chr, range(128)) for b in "abcd \n"), "abc", "abc abd"]
    m = Memory([["abc abd", "abc", ""] * 5, asked], [[False] * 15, [True] * len(asked)])
    assert 0.5 < (2.0 ** -m.bits(1)).sum() <= 1 + 1e-6


def test_both_outcomes_of_every_decision():
    """The first decisions of all 256 bytes in one context: at each node of the tree the two sides' odds are opposite."""
    m = Memory([["the cat sat on the mat. The end\n"] * 3], [[False] * 3])
    keys = (np.uint64(7) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    n = np.random.default_rng(1).integers(0, 9, 256)
    _, odds = m.tree.predictions(keys, n)
    begin = np.concatenate([[0], np.cumsum(m.tree.length)])
    total = np.zeros(256)
    for leaf in range(256):
        p = 1 / (1 + np.exp(-odds[begin[leaf] : begin[leaf + 1]] * lm.SCALE.astype(float)))
        total[leaf] = p.prod()
    assert np.isclose(total.sum(), 1)


def test_scores_do_not_depend_on_company():
    texts = ["one text", "another, longer text " * 300, "ÉÀ", "", "x" * 500 + " end", "one text"]
    one = Memory([texts], [[False] * 6])
    many = Memory([[t] for t in texts], [[False]] * 6)
    assert np.allclose(one.bits(0), [many.bits(i)[0] for i in range(6)], rtol=1e-4)


def test_counts_are_those_of_the_corpus():
    """Whatever the blocks, the odds are those of a count by hand, and contexts grow with the corpus."""
    import random

    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 6))) for _ in range(40)) for _ in range(30)]
    held = [i % 5 == 0 for i in range(30)]
    m = Memory([texts[:7], texts[7:8], texts[8:]], [held[:7], held[7:8], held[8:]])
    after = Counter()
    for t, h in zip(texts, held, strict=True):
        if not h:
            for w in (t + "\x00").replace(" ", " \x01").split("\x01"):
                raw = w.encode().replace(b"\x00", b"\xff")
                after.update((raw[:j], raw[j]) for j in range(len(raw)))
    u, tree = m.units, m.tree
    for i in range(u.u.n):
        raw = u.u.data[u.u.offsets[i] : u.u.offsets[i + 1]].tobytes()
        for j, b in enumerate(raw):
            pair = u.pair[-1][u.u.offsets[i] + j]
            leaf = int(tree.leaf[b])
            by_leaf = np.zeros(256)
            for x in range(256):
                by_leaf[tree.leaf[x]] = after[raw[:j], x]
            odds = u.odds[u.begin[pair] : u.begin[pair + 1]]
            for d, got in enumerate(odds.tolist()):
                same = by_leaf[tree.first[d] == tree.first[d][leaf]].sum()
                taken = by_leaf[tree.first[d + 1] == tree.first[d + 1][leaf]].sum()
                assert got == lm.stretched(np.array([taken]), np.array([same - taken]))[0]
    more = Memory([texts, ["".join(rnd.choice("klmnop") for _ in range(5000))]], [held, [False]])
    assert len(more.units.keys) > len(u.keys) + 5000


def test_weights_come_from_all_training_documents(spark, scratch, monkeypatch):
    """The sums for the weights are those of every training document, not of a sample: as many occurrences."""
    import random

    rnd = random.Random(4)
    docs = [(i, prose(rnd, 12)) for i in range(400)]
    seen, real = [], lm.joined
    monkeypatch.setattr(lm, "joined", lambda sums: (seen.append(sums), real(sums))[1])
    lm.score_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), scratch).count()
    few = []
    lm.score_documents(spark.createDataFrame(docs[:200], "doc_id bigint, text string"), Scratch(spark, "t")).count()
    whole, few = (np.abs(x[0, :, :, :-1]).sum() for x in seen)
    assert whole > 1.5 * few > 0


def test_long_text_keeps_its_weights():
    """The second layer's weights go on adapting: at every step they are what a plain loop over the whole text has."""
    text = "the cat sat on the mat, É. A dog ate " * 150
    m = Memory([["the dog sat. "] * 20, [text, "short"]], [[False] * 20, [True, True]])
    c, a = m.cuts[1], m.answers(1)
    cost, w = 0.0, np.full((lm.LAST_GATES, 2), lm.FIRST)
    units = c.entry[c.before[0] : c.before[1]]
    for s in range(0, len(units), lm.STEP):
        move = np.zeros_like(w)
        for e in units[s : s + lm.STEP].tolist():
            cost += a.sure[e]
            for r in range(a.at[e], a.at[e + 1]):
                x = a.x[:, a.z[r]].astype(float)
                g = a.gate[a.z[r]]
                z = np.clip(w[g] @ x, -30, 30)
                cost += np.log1p(np.exp(-z))
                move[g] += float(lm.RATE) / (1 + np.exp(z)) * x
        w += move
    assert not np.allclose(w, lm.FIRST, atol=0.02)
    assert np.isclose(lm.score(c, a, np.zeros(2))[0], cost / math.log(2), rtol=1e-4)


def test_weights_move_after_every_decision(monkeypatch):
    """Every decision that any weight can change is mixed, and moves the weights before the next one is predicted, side by side or one by one."""
    texts = ["the cat sat on the mat, É. A dog ate " * 60, "short", "", "a dog " * 90, "x" * 300 + " The end."]
    m = Memory([["the dog sat. "] * 20 + texts[:1], texts], [[False] * 21, [True] * 5])
    u, c, a = m.units, m.cuts[1], m.answers(1)
    sure, many, z = u.mixed(m.weights)
    assert z.any(axis=1).all()
    assert np.allclose(sure / math.log(2) + many, np.diff(u.unit_at))
    want = np.zeros(5)
    for i in range(5):
        w = np.full((lm.LAST_GATES, 2), lm.FIRST)
        for e in c.entry[c.before[i] : c.before[i + 1]].tolist():
            want[i] += a.sure[e]
            for r in range(a.at[e], a.at[e + 1]):
                x, g = a.x[:, a.z[r]].astype(float), a.gate[a.z[r]]
                q = w[g] @ x
                want[i] += np.log1p(np.exp(-q))
                w[g] += float(lm.RATE) / (1 + np.exp(q)) * x
    for few, slab, chunk in ((0, 1 << 17, 1 << 20), (3, 50, 500), (99, 70, 1000)):
        monkeypatch.setattr(lm, "FEW", few)
        monkeypatch.setattr(lm, "SLAB", slab)
        monkeypatch.setattr(lm, "CHUNK", chunk)
        assert np.allclose(lm.score(c, a, np.zeros(5)), want / math.log(2), rtol=1e-5)


def test_a_step_takes_six_array_operations(monkeypatch):
    """The second layer's steps are many and their arrays small, so that the number of operations is what they cost."""
    text = "the cat sat on the mat, É. A dog ate " * 100
    m = Memory([["the dog sat. "] * 20, [text] * 4], [[False] * 20, [True] * 4])
    c, a = m.cuts[1], m.answers(1)
    steps, done = lm._lanes(c, a)[0].max(), []

    class Counting:
        def __getattr__(self, name):
            f = getattr(np, name)
            return (lambda *x, **y: (done.append(name), f(*x, **y))[1]) if isinstance(f, np.ufunc) else f

    monkeypatch.setattr(lm, "FEW", 0)
    monkeypatch.setattr(lm, "np", Counting())
    lm._second_layer(c, a)
    assert 6 * steps <= len(done) < 7 * steps


def test_few_lanes_take_many_steps_at_once(monkeypatch):
    """Where few texts are left, rounds over many decisions give what a step for each gives, with far fewer operations."""
    text = "the cat sat on the mat, É. A dog ate " * 100
    m = Memory([["the dog sat. "] * 20, [text, text[:900], "short"]], [[False] * 20, [True] * 3])
    c, a = m.cuts[1], m.answers(1)
    steps, done = lm._lanes(c, a)[0].max(), []
    with monkeypatch.context() as by_step:
        by_step.setattr(lm, "FEW", 0)
        want = lm._second_layer(c, a)

    class Counting:
        def __getattr__(self, name):
            f = getattr(np, name)
            return (lambda *x, **y: (done.append(name), f(*x, **y))[1]) if isinstance(f, np.ufunc) else f

    monkeypatch.setattr(lm, "np", Counting())
    got = lm._second_layer(c, a)
    assert len(done) < steps / 2 and np.allclose(got, want, rtol=1e-6)
    for strong in (1, 30):  # weights that hardly move, and such that jump with every decision
        x = np.random.default_rng(strong).normal(0, strong, (2, 5, 300)).astype(np.float32) * np.float32(math.sqrt(lm.RATE) / 2)
        w = np.full((2, 5), lm.FIRST / math.sqrt(lm.RATE), dtype=np.float32)
        half, move = lm._window(x, w)
        v = w.astype(float)
        for i in range(300):
            q = (v * x[:, :, i]).sum(axis=0)
            assert np.allclose(half[:, i], q, atol=2e-3)
            v -= x[:, :, i] * (1 + np.tanh(q))
        assert np.allclose(w - move, v, atol=2e-3 * abs(v).max())


def test_a_decision_takes_one_exponential_and_one_logarithm(monkeypatch):
    """The error and the cost of a decision come from the same exponential, which is what a step takes most of its time for."""
    text = "the cat sat on the mat, É. A dog ate " * 100
    m = Memory([["the dog sat. "] * 20, [text] * 4], [[False] * 20, [True] * 4])
    taken = Counter()

    class Counting:
        def __getattr__(self, name):
            f = getattr(np, name)
            return (lambda *x, **y: (taken.update({name: np.size(x[0])}), f(*x, **y))[1]) if name in ("exp", "log", "tanh", "log1p", "expm1") else f

    a = m.answers(1)
    monkeypatch.setattr(lm, "FEW", 0)
    monkeypatch.setattr(lm, "np", Counting())
    lm._second_layer(m.cuts[1], a)
    assert set(taken) == {"exp", "log"} and taken["exp"] == taken["log"]


def test_odds_beyond_what_a_number_holds():
    """Weights and predictions as large as can be: costs stay finite, and a sure decision moves nothing."""
    w = np.full((2, 3), 40 / math.sqrt(lm.RATE), dtype=np.float32)
    x = np.full((2, 3, 40), -32 * math.sqrt(lm.RATE) / 2, dtype=np.float32)
    x[:, 1] *= -1
    half, move = lm._window(x, w)
    assert np.isfinite(half).all() and np.isfinite(move).all() and not move[:, [0, 2]].any() and move[:, 1].all()
    cost = lm._costs(np.array([np.inf, 1, 0, 1e-30], dtype=np.float32))
    assert np.allclose(cost, [0, math.log(2), lm.MOST, 30 * math.log(10)], rtol=1e-4)


def test_units_of_a_block_are_told_apart_by_all_their_bytes():
    """Units of every size that differ in one byte or in their size only, zero bytes among them, at the text's end too."""
    rnd = np.random.default_rng(7)
    units = [b"\x00" * k for k in range(1, lm.UNIT + 1)]
    for k in range(1, lm.UNIT + 1):
        u = rnd.integers(1, 256, k, dtype=np.uint8)
        units += [u.tobytes(), *((u ^ (np.arange(k) == i)).astype(np.uint8).tobytes() for i in range(k))]
    size = np.array([len(u) for u in units])
    start = np.cumsum(size) - size
    h = lm.unit_hashes(np.frombuffer(b"".join(units), np.uint8), start, size)
    assert len(set(h.tolist())) == len(set(units))
    again = lm.unit_hashes(np.frombuffer(b"".join(units[::-1]), np.uint8), np.cumsum(size[::-1]) - size[::-1], size[::-1])
    assert np.array_equal(h, again[::-1])


def test_decisions_are_counted_as_often_as_they_occur():
    keys, n, size = np.array([7, 9, 7, 7, 5, 9], np.uint64), np.array([3, 1 << 17, 0, 2]), np.array([2, 1, 1, 2])
    got = Counter()
    for k, t in zip(*lm._times(keys.copy(), n, size), strict=True):
        got[int(k)] += int(t)
    assert got == Counter({7: 3 + (1 << 17), 9: 3 + 2, 5: 2})
    assert not len(lm._times(keys[:0], n[:0], size[:0])[0])


def test_held_out_texts_cost_less_than_the_base_says(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no data")
    got = queries.op6_lm_scores(spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "count(*) n").first()
    assert got.n > 100 and got.s > 0.99 * got.b


ENTRIES = [("bad.com", "spam", "add", "2024-01-10"), ("bad.com", "spam", "remove", "2024-02-10"), ("bad.com", "spam", "add", "2024-03-10"), ("ok.bad.com", "allow", "add", "2024-01-01"), (None, "spam", "add", "2024-01-01"), ("bad.com", "spam", "add", "2024-01-10"), ("x.org", "b", "add", "2024-01-01"), ("x.org", "a", "add", "2024-01-01"), ("x.org", "a", "remove", "2024-01-01")]
CAPTURES = [
    ("http://bad.com/a", "2024-01-09", None), ("http://bad.com/a", "2024-01-10", "spam"), ("https://u@www.BAD.com.:80?q", "2024-02-09", "spam"), ("http://bad.com", "2024-02-10", None), ("http://bad.com", "2025-01-01", "spam"),
    ("http://ok.bad.com/x", "2024-01-15", "allow"), ("http://deep.ok.bad.com/x", "2024-01-15", "allow"), ("http://notbad.com", "2024-01-15", None), ("nonsense", "2024-01-15", None), (None, "2024-01-15", None), ("http://bad.com", None, None), ("http://x.org/1", "2024-01-02", "b"), ("http:///", "2024-01-02", None),
]


def test_url_lists(spark):
    caps = spark.createDataFrame([(i, u, d, "h") for i, (u, d, _) in enumerate(CAPTURES)] * 2, "page_id bigint, url string, fetched string, host string")
    entries = spark.createDataFrame(ENTRIES, "domain string, list string, action string, date string")
    got = urls.judge(caps, entries)
    assert Counter((r.page_id, r.matched_list, r.blocked) for r in got.collect()) == Counter((i, m, m is not None and m != "allow") for i, (_, _, m) in enumerate(CAPTURES) for _ in range(2))
    assert urls.judge(caps, entries.limit(0)).filter("blocked").count() == 0
    assert urls.judge(caps.limit(0), entries).count() == 0


def test_url_query_equals_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{data}/pages.parquet')")
    assert rows(queries.op10_url_filters(spark, data).toPandas()) == rows(con.execute(queries.OP10_SQL).df())


def test_url_plan_has_no_python(spark, data):
    plan = queries.op10_url_filters(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import random

    rnd = random.Random(6)
    item, shared = prose(rnd, 25), prose(rnd, 60)
    docs = [(i, prose(rnd, 120), "en" if i % 2 else "xx", "s", 0) for i in range(30)]
    docs += [(100, docs[0][1], "en", "s", 0), (101, prose(rnd, 30) + " " + item + " " + prose(rnd, 30), "en", "s", 0), (102, "123 456", "en", "s", 0), (103, None, "en", "s", 0)]
    docs += [(110, prose(rnd, 80) + " " + shared, "en", "s", 0), (111, shared + " " + prose(rnd, 90), "en", "s", 0)]
    d = tmp_path / "sf"
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(d / "benchmark.parquet"))
    columns = spark.read.parquet(str(d / "documents.parquet")).columns
    now, scratch, seen = spark.read.parquet(str(d / "documents.parquet")), Scratch(spark, "t"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = scratch.write(stage(spark, now, str(d)), name)
        seen[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns
        if name == "suffix_dedup":
            texts = {r.doc_id: r.text for r in now.collect()}
            assert shared[100:300] not in texts[110] + texts[111]
    assert {102, 103}.isdisjoint(seen["language_id"])
    assert 100 not in seen["near_duplicates"] and 0 in seen["near_duplicates"]
    assert seen["suffix_dedup"] - seen["decontamination"] == {101}
    out = corpus_pipeline.run(spark, str(d))
    assert {r.doc_id for r in out.collect()} == seen["bpe_encoding"] and out.filter("NOT round_trip").count() == 0


def test_url_entries_of_any_length_equal_sql(spark, monkeypatch, tmp_path):
    """Entries of one label and of eight, and hosts longer and shorter than these."""
    eight = "a.b.c.d.e.f.g.com"
    entries = [("xyz", "tld", "add", "2024-01-01"), (eight, "deep", "add", "2024-01-01"), ("b.c.d.e.f.g.com", "seven", "add", "2024-01-01"), ("com", "allow", "add", "2024-01-01")]
    hosts = ["site.xyz", "xyz", "www.a.xyz", "notxyz", eight, f"x.{eight}", f"z.y.x.{eight}", "q.b.c.d.e.f.g.com", "g.com", "x.org"]
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id bigint, url string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(queries, "URL_ENTRIES", entries)
    got = rows(queries.op10_url_filters(spark, str(tmp_path)).toPandas())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    values = queries.OP10_SQL[queries.OP10_SQL.index("days AS") :]
    listed = ", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in entries)
    assert got == rows(con.execute(f"WITH entries(domain, list, action, date) AS (VALUES {listed}), {values}").df())
    assert sum("tld" in r for r in got) == 3 and sum("deep" in r for r in got) == 3
