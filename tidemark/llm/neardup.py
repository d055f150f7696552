"""Near-duplicate documents by MinHash banding, exact confirmation and connected components.

1. Each document gets its set of 5-word shingles (hashed to 64 bits), a 128-bit key of that set, and the
   minima of 128 universal hash functions over it.
2. Documents with equal sets are one class; its smallest doc_id represents it. Only representatives go on.
3. 32 bands of 4 minima make buckets. Two sets of similarity 0.75 share no bucket with probability 5e-6.
4. Star rounds: every bucket names a centre, members of other components than the centre's are compared with
   it on their full sets, and the links are merged into components. The candidates of a round are at most one
   for each member, so a bucket of n members never makes n * n pairs. Rounds use different centres.
5. What is left are buckets that still hold several components. All their pairs across components are
   compared, block by block; only pairs that signatures and smallest shingle hashes don't rule out leave a task. So no link is lost to a cap. Signatures only sort out pairs that are far below the
   threshold (SIGNATURE_LEAST, over 5 standard deviations); links are always confirmed on full sets.

A document is a doc_id: rows that repeat one count once, by the smallest set key among them. Rows with a null
doc_id get a null component and are kept. Null and empty texts have no shingles and are linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepared
from .components import connected
from .text import Scratch, Texts, fresh, map_slices, mix, texts_of, tidied

WORDS, HASHES, BANDS = 5, 128, 32
ROWS = HASHES // BANDS
LEAST = 75  # per cent
SIGNATURE_LEAST = 0.55
#: Smallest shingle hashes (32 bits) that a member brings to its blocks. A set that has no more is compared as a
#: whole there; of larger sets the share of common hashes must reach LOW_LEAST, 5 standard deviations below LEAST.
LOW, LOW_LEAST = 1024, 0.68
STAR_ROUNDS = 4
#: Star rounds end early when buckets that are still open have no more pairs than this for each of their rows.
PAIRS_A_ROW = 24
#: A bucket of n members has sqrt(n / BLOCK) blocks: rows grow with n ** 1.5, a block with n ** 0.5.
BLOCK = 64

_RNG = np.random.default_rng(77)
_A = (_RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]
_K = np.uint64(0xD1342543DE82EF95)


def shingle_sets(t: Texts) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of lower-cased texts."""
    starts, ends, at = t.words()
    h = t.span_hash(starts, ends)
    n = len(h) - WORDS + 1
    if n > 0:
        v = h[:n].copy()
        for k in range(1, WORDS):
            v *= _K
            v += h[k : n + k]
        v = mix(v + np.uint64(WORDS))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(v[a : b - WORDS + 1]))
        elif b > a:
            x = 0
            for w in h[a:b].tolist():
                x = (x * int(_K) + w) % 2**64
            out.append(mix(np.array([(x + b - a) % 2**64], dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """The minima of HASHES functions a * x + b modulo 2**32, a odd."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        part = _A * x[None, i : i + 1024]
        part += _B
        np.minimum(low, part.min(axis=1), out=low)
    return low


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart: two sums of different mixes of the members."""
    a = int(mix(s ^ np.uint64(0x51ED270B35AE2D11)).sum(dtype=np.uint64)) if len(s) else 0
    b = int(mix(s * np.uint64(3) + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)) if len(s) else 0
    return a - 2**63, b - 2**63


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), n, k1, k2 and sig of every row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts_of(b.column(1), lower=True))
        keys = [set_key(s) for s in sets]
        sig = [signature(s).tobytes() if len(s) else None for s in sets]
        cols = [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sig, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "n", "k1", "k2", "sig"])

    return map_slices(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), run, "doc_id bigint, h bigint, n bigint, k1 bigint, k2 bigint, sig binary")


def bands(sigs: DataFrame) -> DataFrame:
    """bucket and rep: BANDS rows of each representative."""
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            k = np.zeros(s.shape[:2], dtype=np.uint64) + salt
            for r in range(ROWS):
                k = mix(k * _K + s[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["bucket", "rep"])

    return sigs.select("rep", "sig").mapInArrow(tidied(run), "bucket bigint, rep bigint")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. texts: (doc_id, text) of all ids in pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                part = batch.slice(i, 16)
                sets = []
                for name in ("a", "b"):
                    ids = part.column(part.schema.get_field_index(name)).to_pylist()
                    text = part.column(part.schema.get_field_index("t" + name))
                    new = [k for k, x in enumerate(ids) if x not in known]
                    if len(known) > 256:
                        known.clear()
                        new = list(range(len(ids)))
                    for k, s in zip(new, shingle_sets(texts_of(text.take(pa.array(new, pa.int32())), lower=True)), strict=True):
                        known[ids[k]] = s
                    sets.append([known[x] for x in ids])
                both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)]
                ok = [100 * n >= LEAST * (len(x) + len(y) - n) for n, x, y in zip(both, *sets, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in ("a", "b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_a = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").mapInArrow(tidied(run), "a bigint, b bigint")


def lows(texts: DataFrame) -> DataFrame:
    """rep and its LOW smallest shingle hashes, sorted, of texts (doc_id, text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts_of(b.column(1), lower=True))
        cut = [np.unique((mix(x ^ np.uint64(0x6A09E667F3BCC909)) >> np.uint64(32)).astype(np.uint32))[:LOW].tobytes() for x in sets]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(cut, pa.binary())], ["rep", "low"])

    return map_slices(texts.select("doc_id", "text"), run, "rep bigint, low binary")


def may_link(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets with these smallest hashes can be similar enough. Equal hashes of different shingles are
    too rare to take more than one per cent off."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    if len(x) < LOW and len(y) < LOW:
        return 100 * both >= (LEAST - 1) * (len(x) + len(y) - both)
    union = np.union1d(x, y)[:LOW]
    return len(np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True)) >= LOW_LEAST * len(union)


def _group_pairs(rep: np.ndarray, comp: np.ndarray, block: np.ndarray, sig: np.ndarray, low: list[np.ndarray]) -> list[tuple[int, int]]:
    """Of the members of one block, or of two, the pairs across components (and blocks) that may be links."""
    two = block.min() != block.max()
    out: list[tuple[int, int]] = []
    for at in range(0, len(rep), 128):
        part = slice(at, at + 128)
        other = block[part, None] < block[None] if two else rep[part, None] < rep[None]
        i, j = np.nonzero((comp[part, None] != comp[None]) & other)
        i += at
        for s in range(0, len(i), 8192):
            x, y = i[s : s + 8192], j[s : s + 8192]
            ok = (sig[x] == sig[y]).sum(axis=1) >= SIGNATURE_LEAST * HASHES
            out += [(int(rep[u]), int(rep[v])) for u, v in zip(x[ok].tolist(), y[ok].tolist(), strict=True) if may_link(low[u], low[v])]
    return [(min(p), max(p)) for p in out]


def _pairs_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows (bucket, bi, bj, rep, comp, block, sig, low), which come ordered by bucket, bi and bj."""
    held: list[pa.RecordBatch] = []
    seen: set[tuple[int, int]] = set()

    def done(rows: pa.Table) -> pa.RecordBatch | None:
        rep, comp, block = (rows.column(c).to_numpy() for c in ("rep", "comp", "block"))
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
        low = [np.frombuffer(x, dtype=np.uint32) for x in rows.column("low").to_pylist()]
        key = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("bucket", "bi", "bj")])
        edge = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(rep)]]).tolist()
        new = []
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            if e - s > 1:
                new += _group_pairs(rep[s:e], comp[s:e], block[s:e], sig[s:e], low[s:e])
        if len(seen) > 1_000_000:
            seen.clear()
        new = list(dict.fromkeys(p for p in new if p not in seen))
        seen.update(new)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], ["a", "b"])

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        first = tuple(b.column(k)[0].as_py() for k in range(3))
        if held and first != last:
            yield done(pa.Table.from_batches(held))
            held = []
        # the last group may go on in the next batch
        key = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)])
        cut = np.flatnonzero((key != key[:, -1:]).any(axis=0))
        cut = int(cut[-1]) + 1 if len(cut) else 0
        if cut:
            yield done(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held = []
        held.append(b.slice(cut))
        last = tuple(key[:, -1].tolist())
    if held:
        yield done(pa.Table.from_batches(held))


def cross_pairs(open_rows: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs (a, b) of members of one bucket but different components that may be links.

    open_rows: (bucket, rep, comp, n), n the bucket's members. A bucket is dealt out in blocks, each two of
    which meet once. Signatures sort out most pairs there, and the smallest shingle hashes
    nearly all the others, so that little more than links ever leaves a task.
    """
    asked = open_rows.select("rep").distinct()
    known = sigs.join(asked, "rep", "left_semi").join(lows(texts.join(asked.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")), "rep")
    dealt = open_rows.withColumn("blocks", F.ceil(F.sqrt(F.col("n") / BLOCK)).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int"))
    dealt = dealt.select("bucket", "rep", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("bucket", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "rep", "comp", "block").join(known, "rep")
    dealt = dealt.select("bucket", "bi", "bj", "rep", "comp", "block", "sig", "low").repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    return dealt.mapInArrow(tidied(_pairs_of_groups), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and h of every document of docs (doc_id, text)."""
    spark = prepared(docs.sparkSession)
    sk = scratch.write(sketches(docs), "sketches")
    one = sk.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("n", "k1", "k2", "h")).alias("s")).select("doc_id", "s.n", "s.k1", "s.k2", "s.h")
    classes = one.filter(F.col("n") > 0).groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    members = scratch.write(one.join(classes, ["n", "k1", "k2"], "left").select("doc_id", "n", "k1", "k2", "h", F.coalesce("rep", "doc_id").alias("rep")), "members")
    reps = members.filter((F.col("doc_id") == F.col("rep")) & (F.col("n") > 0)).select("doc_id", "k1", "k2")
    sigs = scratch.write(sk.join(reps, ["doc_id", "k1", "k2"]).groupBy(F.col("doc_id").alias("rep")).agg(F.first("sig").alias("sig")), "sigs")
    nulls = sk.filter(F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept"), "h")

    every = bands(sigs)
    shared = every.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    rows = scratch.write(every.join(shared, "bucket").select("bucket", "rep"), "buckets")
    asked = rows.select(F.col("rep").alias("doc_id")).distinct()
    texts = scratch.write(own_rows(docs.select("doc_id", "text"), members.join(asked, "doc_id", "left_semi")), "texts")

    links, labels, name = None, None, ""
    for i in range(STAR_ROUNDS + 1):
        at = rows.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("comp")) if labels is not None else rows.select("bucket", "rep", F.col("rep").alias("comp"))
        order = F.xxhash64("rep", F.lit(i)) if i else F.col("rep")
        heads = at.groupBy("bucket").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(order.alias("o"), "rep", "comp")).alias("c")).filter(F.col("lo") < F.col("hi"))
        open_rows = scratch.write(at.join(heads, "bucket").select("bucket", "rep", "comp", "n", F.col("c.rep").alias("centre"), F.col("c.comp").alias("centre_comp")), f"open-{i}")
        size = open_rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum((F.col("n") - 1) / 2), F.lit(0)).alias("pairs")).first()
        if not size.rows:
            break
        last = i == STAR_ROUNDS or (i and size.pairs <= PAIRS_A_ROW * size.rows)
        if last:
            pairs = cross_pairs(open_rows, sigs, texts)
        else:
            star = open_rows.filter(F.col("comp") != F.col("centre_comp")).groupBy("rep", "centre").agg(F.count("*").alias("shared"))
            pairs = star.groupBy("rep").agg(F.max(F.struct("shared", (-F.col("centre")).alias("o"), "centre")).alias("s")).select(F.col("rep").alias("a"), F.col("s.centre").alias("b"))
        found = scratch.write(confirmed(pairs, texts), f"links-{i}")
        links = found if links is None else links.unionByName(found)
        star_links = links if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = connected(star_links, scratch, f"components-{i}")
        rows = open_rows.select("bucket", "rep")
        if last:
            break
    if labels is None:
        out = members.withColumn("component_id", F.col("rep"))
    else:
        out = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "h")
    return scratch.finish(out.unionByName(nulls))


def own_rows(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of docs that stand for the documents in members (doc_id, h): one for each doc_id."""
    h, i, own = fresh(docs, "_h", "_id", "_own")
    wanted = members.select(F.col("doc_id").alias(i), F.col("h").alias(h))
    found = docs.withColumn(own, F.xxhash64("text")).join(wanted, (F.col("doc_id") == F.col(i)) & (F.col(own) == F.col(h)))
    return found.dropDuplicates([i]).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs that are kept: one document of each group."""
    kept = near_duplicates(docs, scratch).filter("kept AND doc_id IS NOT NULL").select("doc_id", "h")
    return own_rows(docs, kept).unionByName(docs.filter("doc_id IS NULL"))
