"""op1, op2 and op9: statistics against plain loops, predictions against held-out labels."""

import pickle
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import langid, quality, queries, rules, stats
from tidemark.llm.text import Texts, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_stats(t):
    w = WORD.findall(t)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines, seen, dup = [x for x in t.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(x in "#*$%&|<>" for x in t), "n_dup_lines": dup, "n_repeat_words": len(covered), "n_distinct_words": len(set(w)), "n_lines": len(lines), "n_chars": len(t)}


def test_statistics(odd, odd_rows, empty):
    got = sorted((r.asDict() for r in stats.document_stats(odd).collect()), key=lambda r: (str(r["doc_id"]), r["n_words"]))
    want = sorted(({"doc_id": i} | plain_stats(t or "") for i, t, _, _ in odd_rows), key=lambda r: (str(r["doc_id"]), r["n_words"]))
    for g, w in zip(got, want, strict=True):
        assert {k: g[k] for k in w} == w
    assert stats.document_stats(empty).count() == 0


def test_repetitions():
    text = "a b c\na b c\n\n x y\na b c d a b\nx y"
    s = stats.statistics(Texts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])))
    assert {k: int(v[0]) for k, v in s.items() if k in (p := plain_stats(text))} == p


def test_languages_held_out(spark, data):
    rows = queries.op1_language_id(spark, data).join(queries.table(spark, data, "documents"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held if r.lang]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(odd, empty, spark):
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd).collect()]
    assert len(got) == odd.count()
    assert all(p == "und" and s == 0 for i, p, s in got if i in (1, 2, 3))
    assert langid.identify(empty).count() == 0
    unlabelled = langid.identify(odd.withColumn("lang", odd.lang.substr(1, 0)).filter("lang is null"))
    assert {r.lang_pred for r in unlabelled.collect()} <= {"und"}
    kept = langid.keep_known(odd)
    assert kept.schema == odd.schema and kept.filter("text is null or trim(text) = ''").count() == 0


def test_backoff_order():
    m = langid.Model.fit([("aaa aaa bbb bbb", "x"), ("ccc ccc ddd ddd", "y")])
    assert m.predict(["aaa"])[0] == ["x"] and m.predict(["cccc"])[0] == ["y"]
    assert m.predict(["12 34"])[0] == ["und"]


def test_tables_are_small():
    """A worker's model takes no array for each entry."""
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghijkl", k=6)) for _ in range(3000)]
    entries = len(set(words)) + sum(len({g for w in words for g in langid.ngrams(w, n)}) for n in range(1, 6))
    raw = pickle.dumps(langid.Model.fit([(" ".join(words), x) for x in "xyz"]))
    tracemalloc.start()
    m = pickle.loads(raw)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert used < 180 * entries and m.languages == ["x", "y", "z"]


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / max(n1 * (len(y) - n1), 1)


def test_quality_held_out(spark, data):
    got = queries.op2_quality(spark, data)
    assert got.count() == queries.table(spark, data, "documents").count()
    rows = got.join(queries.table(spark, data, "labels"), "doc_id").filter("held_out").toPandas()
    assert ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    if rows.quality.nunique() == 2:
        assert auc(rows.quality.to_numpy(), rows.score.to_numpy()) > 0.9


def test_quality_of_odd_texts(odd, empty, spark, scratch):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.score_documents(odd, none, scratch).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(10, 15)] + [(2, None), (None, 1), (3, 7)], "doc_id bigint, quality int")
    got = quality.score_documents(odd, some, type(scratch)(spark, "t")).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score_documents(empty, some, type(scratch)(spark, "t")).count() == 0


def test_discriminant_matches_densities():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(200, 3)), rng.normal(size=(300, 3)) * 2 + 1]
    m = quality.Discriminant(np.array([200.0, 300.0]), np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x]), 0, 0)
    at = rng.normal(size=(5, 3))
    dens = []
    for v in x:
        a = 3 / (3 + len(v))
        c = [np.cov(u.T, bias=True) for u in x]
        pooled = (c[0] * 200 + c[1] * 300) / 500
        cov = (1 - a) * np.cov(v.T, bias=True) + a * pooled + 1e-6 * np.eye(3)
        d = at - v.mean(0)
        dens.append(np.log(len(v) / 500) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)))
    assert np.allclose(m.score(at), 1 / (1 + np.exp(dens[0] - dens[1])))


def test_rules_on_labels(spark, data):
    out = queries.op9_quality_rules(spark, data)
    rows = out.join(queries.table(spark, data, "labels"), "doc_id").toPandas()
    assert not (rows.kept & rows.base_failed).any()
    ok = rows[~rows.base_failed]
    assert (~ok.kept[ok.quality == 1]).mean() < 0.05


def test_rules_of_odd_texts(odd, empty, spark, scratch):
    labels = spark.createDataFrame([(1, 0), (None, 1)], "doc_id bigint, quality int")
    got = rules.judge(odd, labels, scratch).collect()
    assert len(got) == odd.count() and not any(r.kept for r in got if r.n_words < 50)
    assert rules.judge(empty, labels, type(scratch)(spark, "t")).count() == 0


def test_covering_learns_a_conjunction():
    rng = np.random.default_rng(3)
    x = {m: rng.random(3000) for m in rules.MEASURES}
    bad = (x["bang_share"] > 0.7) & (x["upper_share"] <= 0.4) | (x["symbol_share"] > 0.9)
    found = rules.learn(x, bad)
    said = np.zeros(len(bad), bool)
    for r in found:
        said |= rules.covers(r, x, len(bad))
    assert (said == bad).mean() > 0.98
    assert rules.as_sql([]) == "0" and rules.as_sql(found).startswith("CASE WHEN")
    assert rules.learn({m: np.empty(0) for m in rules.MEASURES}, np.empty(0, bool)) == []


def test_word_hashes_tell_words_apart():
    t = texts_of(__import__("pyarrow").array(["ab abc ab", None, "ab"]))
    s, e, at = t.words()
    h = t.span_hash(s, e)
    assert h[0] == h[2] == h[3] != h[1] and at.tolist() == [0, 3, 3, 4]


@pytest.mark.parametrize("limit", [1, 10, 1 << 20])
def test_slices_cover_a_batch(limit):
    import pyarrow as pa

    from tidemark.llm.text import slices

    b = pa.RecordBatch.from_pydict({"text": ["abc", None, "", "x" * 50, "y"], "i": list(range(5))})
    assert [i for p in slices(b, "text", limit) for i in p.column("i").to_pylist()] == list(range(5))
    assert list(slices(b.slice(0, 0), "text")) == []
