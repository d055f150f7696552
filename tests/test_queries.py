"""Every query beside its SQL, on the smallest driver tables."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as entry
from tidemark.plans import derived, queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(name, spark, data, duck):
    got = queries.QUERIES[name](spark, data).toPandas()
    want = duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_no_query_is_empty(spark, data):
    """Each invariant's fault is planted, so that a check that finds nothing shows."""
    found = {name: queries.QUERIES[name](spark, data).count() for name in queries.SQL if name.startswith("invariant_")}
    assert all(found.values()), found


def test_folds(spark, data):
    """Segment split and flush trigger against plain loops."""
    from tidemark.operators import append
    from tidemark.plans import fixture

    r = fixture.records(spark, data).select("topic", "flush_ts", "event_id", "bytes")
    got = append.split_segments(r, fixture.KEY, ["event_id"], "bytes", 40).toPandas()
    for _, g in got.groupby(["topic", "flush_ts"]):
        g = g.sort_values("event_id")
        chunk, held = 0, 0
        for i, (n, c) in enumerate(zip(g["bytes"], g["chunk"], strict=True)):
            if i and held + n > 40:
                chunk, held = chunk + 1, 0
            held += n
            assert c == chunk
    e = fixture.records(spark, data).selectExpr("topic", "event_id", "bytes", "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 1000 AS ms")
    got = append.assign_flushes(e, "topic", ["event_id"], "ms", "bytes", 200, 3_600_000).toPandas()
    for _, g in got.groupby("topic"):
        flush, held, first = 0, 0, None
        for r in g.sort_values("event_id").itertuples():
            if first is not None and (held >= 200 or r.ms - first >= 3_600_000):
                flush, held, first = flush + 1, 0, None
            first = r.ms if first is None else first
            held += r.bytes
            assert r.flush_id == flush


def test_scan_keeps_budget_rule(spark, data):
    from tidemark.operators import scan
    from tidemark.plans import fixture

    out = scan.budget_scan(fixture.index(spark, data), 0, 1).collect()
    assert len(out) == len(fixture.TOPICS)  # the first segment always comes


def test_client_reads_whole_topics(spark, tmp_path):
    """Topics of over 256 segments of 2,000 bytes, types that the fixture doesn't know, records without a value."""
    e = spark.range(30_000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id AS user_id", "CASE WHEN id < 29000 THEN 'view' WHEN id < 29500 THEN 'new' WHEN id < 29990 THEN NULL ELSE 'click' END AS event_type", "CAST(id AS DOUBLE) AS value", "CASE WHEN id % 7 > 0 THEN concat('{\"k\": ', id, ', \"text\": \"', repeat('x', 10), '\"}') END AS props")
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = queries.QUERIES["client_append_read"](spark, str(tmp_path)).toPandas()
    assert len(got) == 3 and rows(got) == rows(con.execute(queries.SQL["client_append_read"]).df())


def test_folds_pass_records_on_by_batches(spark):
    """A worker never holds a broker's records: over many small batches the numbers go on, nulls as in SQL."""
    from tidemark.operators import append

    r = spark.range(3000).selectExpr("id", "id % 3 AS b", "CASE WHEN id % 11 > 0 THEN id % 17 END AS n", "CASE WHEN id % 13 > 0 THEN id * 10 END AS ms").repartition(5, "n")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    try:
        split, flushes = append.split_segments(r, ["b"], ["id"], "n", 40), append.assign_flushes(r, "b", ["id"], "ms", "n", 60, 500)
        for made in (split, flushes):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "FlatMapGroups" not in plan and "MapInArrow" in plan
        split, flushes = ([tuple(x) for x in m.orderBy("b", "id").collect()] for m in (split, flushes))
    finally:
        spark.conf.set(batch, old)
    assert len(split) == len(flushes) == 3000
    last = None
    for (id_, b, n, _, chunk), (*_, ms, flush) in zip(split, flushes, strict=True):
        if b != last:
            last, c, f, held, kept, first, start = b, 0, 0, 0, 0, None, True
        # None: a sum or an age that nobody knows, which decides nothing
        if not start and held is not None and n is not None and held + n > 40:
            c, held = c + 1, 0
        held = None if held is None or n is None else held + n
        if not start and ((kept is not None and kept >= 60) or (ms is not None and first is not None and ms - first >= 500)):
            f, kept, first = f + 1, 0, ms
        first, start = ms if start else first, False
        kept = None if kept is None or n is None else kept + n
        assert (chunk, flush) == (c, f), id_


def test_selfcheck_stays_on_executors(spark, tmp_path, monkeypatch):
    """The driver's codec isn't called and gets no record; records without a value count, as in SQL."""
    from tidemark.functions import codec

    def refuse(*_):
        raise AssertionError("on the driver")

    for name in ("encode_segment", "decode_segment"):
        monkeypatch.setattr(codec, name, refuse)
    monkeypatch.setattr(DataFrame, "toLocalIterator", refuse)
    spark.range(1000).selectExpr("id AS event_id", "CASE WHEN id % 5 > 0 THEN concat('é', id) END AS props").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["codec_selfcheck"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(1000,)]
    spark.range(0).selectExpr("id AS event_id", "'' AS props").write.parquet(f"{tmp_path}/none/events.parquet")
    assert queries.QUERIES["codec_selfcheck"](spark, f"{tmp_path}/none").first()[0] == 0
