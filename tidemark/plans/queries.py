"""One query for each relational operator, over the driver tables, beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import admin, append, groups, materialize, reports, scan, verify
from . import fixture as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "2024-01-20 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.lstrip().startswith("WITH") else f"WITH RECURSIVE {fx.SQL}{sql}"
        return f

    return add


# --- writing ------------------------------------------------------------------------------------------------

@query("SELECT topic, event_id, _offset FROM log")
def offset_allocation(spark, d):
    return fx.log(spark, d).select("topic", "event_id", "_offset")


@query("SELECT topic, strftime(flush_ts, '%Y-%m-%d %H:%M:%S') AS flush, record_count, byte_length, start_offset, end_offset FROM seg")
def segment_index(spark, d):
    return fx.index(spark, d).select("topic", fx.as_text("flush_ts").alias("flush"), "record_count", "byte_length", "start_offset", "end_offset")


@query("SELECT topic, CAST(sum(record_count) AS BIGINT) AS delta FROM seg GROUP BY topic")
def topic_deltas(spark, d):
    return append.topic_deltas(fx.index(spark, d))


@query(""", req AS (SELECT topic, flush_ts, writer_id, count(*) AS n FROM rec GROUP BY ALL)
SELECT r.topic, strftime(r.flush_ts, '%Y-%m-%d %H:%M:%S') AS flush, writer_id,
       start_offset + CAST(sum(n) OVER w AS BIGINT) - n AS ack_start, start_offset + CAST(sum(n) OVER w AS BIGINT) AS ack_end
FROM req r JOIN seg s ON r.topic = s.topic AND r.flush_ts = s.flush_ts
WINDOW w AS (PARTITION BY r.topic, r.flush_ts ORDER BY writer_id)""")
def ack_slices(spark, d):
    req = fx.records(spark, d).groupBy(*fx.KEY, "writer_id").agg(F.count("*").alias("n"))
    out = append.acks(req, fx.index(spark, d), fx.KEY, ["writer_id"])
    return out.select("topic", fx.as_text("flush_ts").alias("flush"), "writer_id", F.col("start_offset").alias("ack_start"), F.col("end_offset").alias("ack_end"))


@query("""WITH rec AS (
  SELECT 'orders' AS topic, year(o_orderdate) AS flush, count(*) AS record_count FROM orders GROUP BY ALL
  UNION ALL SELECT 'lineitem', year(l_shipdate), count(*) FROM lineitem GROUP BY ALL)
SELECT topic, CAST(flush AS INTEGER) AS flush, record_count, CAST(sum(record_count) OVER w AS BIGINT) - record_count AS start_offset,
       CAST(sum(record_count) OVER w AS BIGINT) AS end_offset FROM rec WINDOW w AS (PARTITION BY topic ORDER BY flush)""")
def multi_topic_append(spark, d):
    orders = fx.table(spark, d, "orders").select(F.lit("orders").alias("topic"), F.year("o_orderdate").alias("flush"), F.lit(1).alias("size"))
    items = fx.table(spark, d, "lineitem").select(F.lit("lineitem").alias("topic"), F.year("l_shipdate").alias("flush"), F.lit(1).alias("size"))
    return append.allocate(append.segments(orders.unionByName(items), ["topic"], "flush", "size"), ["flush"]).drop("byte_length")


def _turns(spark, d):
    t = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("writer_id"), F.col("turn").alias("append_seq"))
    return t, t.groupBy("writer_id").agg(F.floor(F.max("append_seq") / 2).alias("last_seq"))


_TURNS = """WITH t AS (SELECT conv_id AS writer_id, turn AS append_seq FROM conversations),
st AS (SELECT writer_id, max(append_seq) // 2 AS last_seq FROM t GROUP BY 1),
o AS (SELECT t.*, CASE WHEN append_seq = last_seq THEN 'duplicate' WHEN append_seq < last_seq THEN 'stale' ELSE 'accept' END AS outcome
      FROM t JOIN st USING (writer_id))
"""


@query(_TURNS + "SELECT writer_id, append_seq, outcome FROM o")
def dedup_outcome(spark, d):
    return append.dedup_outcome(*_turns(spark, d)).select("writer_id", "append_seq", "outcome")


@query(_TURNS + """, h AS (SELECT writer_id, max(append_seq) AS hi FROM t WHERE append_seq % 3 = 0 GROUP BY 1)
SELECT o.writer_id, append_seq, coalesce(outcome = 'accept' OR (outcome = 'stale' AND hi > append_seq), false) AS admitted FROM o LEFT JOIN h USING (writer_id)""")
def stale_allowed_in_flight(spark, d):
    t, state = _turns(spark, d)
    return append.admit_stale(append.dedup_outcome(t, state), t.filter("append_seq % 3 = 0")).select("writer_id", "append_seq", "admitted")


@query(""", r AS (SELECT event_id, writer_id, event_id // 2 AS append_seq FROM rec UNION ALL SELECT event_id + 1000000000, writer_id, event_id // 2 FROM rec WHERE event_id % 7 = 0)
SELECT event_id, writer_id, append_seq, min(event_id) OVER (PARTITION BY writer_id, append_seq) AS leader FROM r""")
def in_flight_coalesce(spark, d):
    r = fx.records(spark, d).select("event_id", "writer_id", F.floor(F.col("event_id") / 2).alias("append_seq"))
    again = r.filter("event_id % 7 = 0").withColumn("event_id", F.col("event_id") + 1000000000)
    return append.coalesce_in_flight(r.unionByName(again), "event_id")


@query(""", s AS (SELECT writer_id, max(event_id) AS last_seq FROM rec WHERE event_id % 5 = 0 GROUP BY 1 UNION ALL SELECT writer_id, max(event_id) FROM rec WHERE event_id % 3 = 0 GROUP BY 1)
SELECT writer_id, max(last_seq) AS last_seq FROM s GROUP BY 1""")
def writer_state_upsert(spark, d):
    r = fx.records(spark, d)
    state = r.filter("event_id % 5 = 0").groupBy("writer_id").agg(F.max("event_id").alias("last_seq"))
    return append.upsert_writers(state, r.filter("event_id % 3 = 0"), seq="event_id")


@query(f"""SELECT writer_id, strftime(max(flush_ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM rec GROUP BY 1 HAVING max(flush_ts) >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS""")
def stale_writer_gc(spark, d):
    state = fx.records(spark, d).groupBy("writer_id").agg(F.max("flush_ts").alias("updated_at"))
    return append.live_writers(state, fx.moment(NOW)).withColumn("updated_at", fx.as_text("updated_at"))


@query("""SELECT topic, strftime(flush_ts, '%Y-%m-%d %H:%M:%S') AS flush, coalesce(last_value(CASE WHEN byte_length >= 80 THEN true WHEN byte_length <= 20 THEN false END IGNORE NULLS)
  OVER (PARTITION BY topic ORDER BY flush_ts ROWS UNBOUNDED PRECEDING), false) AS pressed FROM seg""")
def backpressure_flags(spark, d):
    out = append.pressure(fx.index(spark, d), "flush_ts", "byte_length", ["topic"], on=80, off=20)
    return out.select("topic", fx.as_text("flush_ts").alias("flush"), "pressed")


@query(""", o AS (SELECT *, row_number() OVER (PARTITION BY topic, flush_ts ORDER BY event_id) AS n FROM rec),
cut AS (SELECT topic, flush_ts, n, bytes, bytes AS held, 0 AS chunk FROM o WHERE n = 1
 UNION ALL SELECT o.topic, o.flush_ts, o.n, o.bytes, CASE WHEN c.held + o.bytes > 40 THEN o.bytes ELSE c.held + o.bytes END, CASE WHEN c.held + o.bytes > 40 THEN c.chunk + 1 ELSE c.chunk END
 FROM cut c JOIN o ON o.topic = c.topic AND o.flush_ts = c.flush_ts AND o.n = c.n + 1)
SELECT topic, strftime(flush_ts, '%Y-%m-%d %H:%M:%S') AS flush_ts, CAST(chunk AS BIGINT) AS chunk, count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes FROM cut GROUP BY ALL""")
def segment_split(spark, d):
    r = fx.records(spark, d).select("topic", "flush_ts", "event_id", "bytes")
    return append.split_segments(r, fx.KEY, ["event_id"], "bytes", 40).groupBy(*fx.KEY, "chunk").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes")).withColumn("flush_ts", fx.as_text("flush_ts"))


@query(""", o AS (SELECT topic, bytes, epoch_ms(ts) - epoch_ms(TIMESTAMP '2024-01-01') AS ms, row_number() OVER (PARTITION BY topic ORDER BY event_id) AS n FROM rec),
f AS (SELECT topic, n, bytes, bytes AS held, ms AS began, 0 AS flush_id FROM o WHERE n = 1
 UNION ALL SELECT o.topic, o.n, o.bytes, CASE WHEN held >= 200 OR o.ms - began >= 3600000 THEN o.bytes ELSE held + o.bytes END,
  CASE WHEN held >= 200 OR o.ms - began >= 3600000 THEN o.ms ELSE began END, CASE WHEN held >= 200 OR o.ms - began >= 3600000 THEN flush_id + 1 ELSE flush_id END
 FROM f JOIN o ON o.topic = f.topic AND o.n = f.n + 1)
SELECT topic, CAST(flush_id AS BIGINT) AS flush_id, count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes FROM f GROUP BY ALL""")
def flush_trigger(spark, d):
    r = fx.records(spark, d).select("topic", "event_id", "bytes", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 1000").alias("ms"))
    return append.assign_flushes(r, "topic", ["event_id"], "ms", "bytes", 200, 3_600_000).groupBy("topic", "flush_id").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"))


# --- reading ------------------------------------------------------------------------------------------------

_SCAN = """, sel AS (SELECT * FROM (SELECT *, row_number() OVER w AS n, coalesce(sum(byte_length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM seg WHERE end_offset > 100 WINDOW w AS (PARTITION BY topic ORDER BY start_offset)) WHERE n <= 256 AND before < 4000)
"""


@query(_SCAN + "SELECT topic, start_offset, end_offset, byte_length FROM sel")
def byte_budget_scan(spark, d):
    return scan.budget_scan(fx.index(spark, d), 100, 4000).select("topic", "start_offset", "end_offset", "byte_length")


def _fetched(spark, d):
    chosen = scan.budget_scan(fx.index(spark, d), 100, 4000)
    return scan.fetch(fx.log(spark, d), chosen, fx.KEY, 100, 2500, "bytes", end=900)


@query(_SCAN + """SELECT topic, event_id, _offset FROM (SELECT l.topic, event_id, _offset, coalesce(sum(bytes) OVER (PARTITION BY l.topic ORDER BY _offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM log l JOIN sel s ON l.topic = s.topic AND l.flush_ts = s.flush_ts WHERE _offset >= 100 AND _offset < 900) WHERE before < 2500""")
def bounded_fetch(spark, d):
    return _fetched(spark, d).select("topic", "event_id", "_offset")


@query(_SCAN + """SELECT topic, count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, max(_offset) AS last_offset FROM (SELECT l.topic, bytes, _offset, coalesce(sum(bytes) OVER (PARTITION BY l.topic ORDER BY _offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM log l JOIN sel s ON l.topic = s.topic AND l.flush_ts = s.flush_ts WHERE _offset >= 100 AND _offset < 900) WHERE before < 2500 GROUP BY topic""")
def read_summary(spark, d):
    return _fetched(spark, d).groupBy("topic").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"), F.max("_offset").alias("last_offset"))


@query(", t AS (SELECT * FROM (VALUES ('view'), ('click'), ('none')) v(topic)) SELECT t.topic, coalesce(max(end_offset), 0) AS high_watermark FROM t LEFT JOIN seg USING (topic) GROUP BY 1")
def high_watermark(spark, d):
    topics = spark.createDataFrame([("view",), ("click",), ("none",)], "topic string")
    return scan.high_watermark(topics, fx.index(spark, d))


@query(", p AS (SELECT topic, _offset + 3 AS offset FROM log) SELECT p.topic, p.offset, s.start_offset, s.end_offset FROM p LEFT JOIN seg s ON p.topic = s.topic AND s.start_offset <= p.offset AND p.offset < s.end_offset")
def segment_point_lookup(spark, d):
    points = fx.log(spark, d).select("topic", (F.col("_offset") + 3).alias("offset"))
    return scan.segment_of(points, fx.index(spark, d))


@query(""", x AS (SELECT topic, _offset, 100 + writer_id % 3 AS schema_id FROM log),
y AS (SELECT *, CASE WHEN lag(schema_id) OVER w = schema_id THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY topic ORDER BY _offset)),
z AS (SELECT *, sum(new) OVER (PARTITION BY topic ORDER BY _offset) AS run FROM y)
SELECT topic, schema_id, min(_offset) AS first_offset, max(_offset) AS last_offset, count(*) AS records FROM z GROUP BY topic, schema_id, run""")
def schema_runs(spark, d):
    return scan.schema_runs(fx.log(spark, d).select("topic", "_offset", (100 + F.col("writer_id") % 3).alias("schema_id")))


@query("""SELECT '{"offset":' || event_id || ',"key":' || CASE WHEN event_id % 4 = 0 THEN 'null' ELSE '"' || event_type || '"' END || ',"value":' || to_json(props) || '}' AS line FROM events""")
def json_lines(spark, d):
    e = fx.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("k"), "props")
    return scan.json_lines(e, "event_id", "k", "props")


@query("SELECT topic, _offset, event_id FROM log ORDER BY _offset DESC, topic LIMIT 100")
def bounded_tail(spark, d):
    return scan.bounded_tail(fx.log(spark, d).select("topic", "_offset", "event_id"), [F.desc("_offset"), F.col("topic")], 100)


# --- reader groups ------------------------------------------------------------------------------------------

_LEASES = """, ls AS (SELECT topic, start_offset, end_offset, 'r' || (batch_id % 3) AS reader_id, flush_ts + INTERVAL 45 SECONDS AS lease_expires_at FROM bat WHERE batch_id % 7 = 0),
cur AS (SELECT topic, max(end_offset) // 2 AS cursor FROM seg GROUP BY 1)
"""


def _leases(spark, d):
    b = fx.batches(spark, d).filter("batch_id % 7 = 0")
    return b.select("topic", "start_offset", "end_offset", F.concat(F.lit("r"), F.col("batch_id") % 3).alias("reader_id"), (F.col("flush_ts") + F.expr("INTERVAL 45 SECONDS")).alias("lease_expires_at"))


def _cursors(spark, d):
    return fx.index(spark, d).groupBy("topic").agg(F.floor(F.max("end_offset") / 2).alias("cursor"))


@query(_LEASES + "SELECT cur.topic, coalesce(min(start_offset), any_value(cursor)) AS watermark FROM cur LEFT JOIN ls l ON cur.topic = l.topic GROUP BY 1")
def committed_watermark(spark, d):
    return groups.committed_watermark(_cursors(spark, d), _leases(spark, d))


@query(_LEASES + "SELECT cur.topic, least(any_value(cursor), coalesce(min(start_offset), any_value(cursor))) AS cursor FROM cur LEFT JOIN (SELECT * FROM ls WHERE reader_id = 'r1') l ON cur.topic = l.topic GROUP BY 1")
def cursor_rollback(spark, d):
    return groups.roll_back(_cursors(spark, d), _leases(spark, d).filter("reader_id = 'r1'"))


@query(f""", m AS (SELECT topic, writer_id AS reader_id, max(ts) AS seen FROM rec GROUP BY ALL) SELECT topic, reader_id FROM m WHERE seen < TIMESTAMP '{NOW}' - INTERVAL 30 SECONDS""")
def expired_members(spark, d):
    m = fx.records(spark, d).groupBy("topic", F.col("writer_id").alias("reader_id")).agg(F.max("ts").alias("last_heartbeat"))
    return groups.expired_members(m, fx.moment(NOW)).select("topic", "reader_id")


@query(_LEASES + f"SELECT topic, start_offset, end_offset, reader_id FROM ls WHERE lease_expires_at < TIMESTAMP '{NOW}' QUALIFY row_number() OVER (PARTITION BY topic ORDER BY start_offset) = 1")
def steal_expired_lease(spark, d):
    return groups.steal(_leases(spark, d), fx.moment(NOW))


@query(_LEASES + ", m AS (SELECT DISTINCT topic, 'r' || (writer_id % 4) AS reader_id FROM rec) SELECT m.topic, m.reader_id, count(ls.topic) AS in_flight, count(ls.topic) < 10 AS may_poll FROM m LEFT JOIN ls ON m.topic = ls.topic AND m.reader_id = ls.reader_id GROUP BY ALL")
def max_in_flight_readers(spark, d):
    m = fx.records(spark, d).select("topic", F.concat(F.lit("r"), F.col("writer_id") % 4).alias("reader_id")).distinct()
    return groups.may_poll(m, _leases(spark, d))


@query(_LEASES + """SELECT topic, any_value(cursor) AS start_offset, max(end_offset) AS end_offset FROM (SELECT seg.*, cursor, row_number() OVER w AS n, coalesce(sum(byte_length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM seg JOIN cur USING (topic) WHERE end_offset > cursor WINDOW w AS (PARTITION BY topic ORDER BY start_offset)) WHERE n <= 10 AND before < 300 GROUP BY 1""")
def poll_dispatch(spark, d):
    return groups.dispatch(fx.index(spark, d), _cursors(spark, d), 300)


@query(_LEASES + ", wm AS (SELECT topic, min(start_offset) AS watermark FROM ls GROUP BY 1) SELECT topic, watermark AS cursor, watermark FROM wm")
def force_reset(spark, d):
    return groups.reset(_cursors(spark, d), groups.committed_watermark(_cursors(spark, d), _leases(spark, d)))


@query(", g AS (SELECT DISTINCT topic FROM rec UNION ALL SELECT 'idle'), m AS (SELECT DISTINCT topic, writer_id FROM rec) SELECT g.topic, count(m.topic) AS members FROM g LEFT JOIN m USING (topic) GROUP BY 1")
def group_summary(spark, d):
    r = fx.records(spark, d)
    g = r.select("topic").distinct().unionByName(spark.createDataFrame([("idle",)], "topic string"))
    return groups.summaries(g, r.select("topic", "writer_id").distinct())


# --- materialisation ----------------------------------------------------------------------------------------

_CLAIMS = f""", cl AS (SELECT batch_id, ingest_time, CASE WHEN batch_id % 3 = 0 THEN 'completed' ELSE 'pending' END AS status, TIMESTAMP '{NOW}' - to_seconds(batch_id % 600) AS claimed_at FROM bat WHERE batch_id % 3 = 0 OR batch_id % 5 = 0)
"""


def _claims(spark, d):
    b = fx.batches(spark, d).filter("batch_id % 3 = 0 OR batch_id % 5 = 0")
    return b.select("batch_id", "ingest_time", F.when(F.col("batch_id") % 3 == 0, "completed").otherwise("pending").alias("status"), (fx.moment(NOW) - F.make_dt_interval(secs=F.col("batch_id") % 600)).alias("claimed_at"))


@query(_CLAIMS + "SELECT bat.batch_id, topic, start_offset FROM bat ANTI JOIN cl ON bat.batch_id = cl.batch_id AND bat.ingest_time = cl.ingest_time ORDER BY start_offset, bat.batch_id LIMIT 100")
def unclaimed_batches(spark, d):
    return materialize.unclaimed(fx.batches(spark, d), _claims(spark, d)).select("batch_id", "topic", "start_offset")


@query(_CLAIMS + f"SELECT batch_id, status FROM cl WHERE NOT (status = 'pending' AND claimed_at < TIMESTAMP '{NOW}' - INTERVAL 300 SECONDS)")
def expire_claims(spark, d):
    return materialize.expire_claims(_claims(spark, d), fx.moment(NOW)).select("batch_id", "status")


@query(_CLAIMS + ", dn AS (SELECT batch_id FROM bat WHERE batch_id % 10 = 5) SELECT coalesce(cl.batch_id, dn.batch_id) AS batch_id, CASE WHEN dn.batch_id IS NOT NULL THEN 'completed' ELSE status END AS status FROM cl FULL JOIN dn ON cl.batch_id = dn.batch_id")
def mark_completed(spark, d):
    return materialize.mark_completed(_claims(spark, d), fx.batches(spark, d).filter("batch_id % 10 = 5"))


_WM = ", wm AS (SELECT topic, max(batch_id) AS watermark FROM bat WHERE flush_ts < TIMESTAMP '2024-01-10 00:00:00' AND topic <> 'view' GROUP BY 1)\n"


def _watermarks(spark, d):
    return fx.batches(spark, d).filter((F.col("flush_ts") < fx.moment("2024-01-10 00:00:00")) & (F.col("topic") != "view")).groupBy("topic").agg(F.max("batch_id").alias("watermark"))


@query(_WM + "SELECT batch_id, bat.topic FROM bat LEFT JOIN wm ON bat.topic = wm.topic WHERE watermark IS NULL OR batch_id > watermark")
def snapshot_watermark_filter(spark, d):
    return materialize.after_watermark(fx.batches(spark, d), _watermarks(spark, d)).select("batch_id", "topic")


@query(_WM + ", nw AS (SELECT topic, max(batch_id) AS b FROM bat WHERE batch_id % 4 = 0 GROUP BY 1) SELECT coalesce(wm.topic, nw.topic) AS topic, greatest(watermark, b) AS watermark FROM wm FULL JOIN nw ON wm.topic = nw.topic")
def watermark_merge(spark, d):
    return materialize.merge_watermarks(_watermarks(spark, d), fx.batches(spark, d).filter("batch_id % 4 = 0"))


@query(", g AS (SELECT topic, min(batch_id) AS gap FROM bat WHERE batch_id % 97 = 0 GROUP BY 1) SELECT bat.topic, coalesce(any_value(gap) - 1, max(batch_id)) AS watermark FROM bat LEFT JOIN g ON bat.topic = g.topic GROUP BY 1")
def contiguous_watermark(spark, d):
    b = fx.batches(spark, d)
    return materialize.contiguous_watermark(b, b.filter("batch_id % 97 <> 0"))


_CASES = [("free", None, None, None, "a"), ("same", "a", 4, "2024-01-20 00:01:00", "a"), ("other", "b", 4, "2024-01-20 00:01:00", "a"), ("expired own", "a", 4, "2024-01-19 00:00:00", "a"), ("expired other", "b", 7, "2024-01-19 00:00:00", "a"), ("now", "b", 7, NOW, "a")]


def _literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


@query(f"""WITH c(name, holder, epoch, expiry, asked_by) AS (VALUES {_values(_CASES)})
SELECT name, CAST(CASE WHEN holder IS NULL THEN 1 WHEN CAST(expiry AS TIMESTAMP) <= TIMESTAMP '{NOW}' THEN epoch + 1 WHEN holder = asked_by THEN epoch END AS BIGINT) AS granted_epoch FROM c""")
def lease_acquire_cases(spark, d):
    rows = spark.createDataFrame(_CASES, "name string, holder string, epoch bigint, expiry string, asked_by string").withColumn("lease_expiry", F.col("expiry").cast("timestamp_ntz"))
    return materialize.acquire(rows, fx.moment(NOW)).select("name", "granted_epoch")


@query(f"SELECT topic, byte_length >= 60 OR flush_ts <= TIMESTAMP '{NOW}' - INTERVAL 60 SECONDS AS due, byte_length AS bytes, strftime(flush_ts, '%Y-%m-%d %H:%M:%S') AS first_at FROM seg")
def sink_flush_policy(spark, d):
    b = fx.index(spark, d).select("topic", F.col("byte_length").alias("bytes"), F.col("flush_ts").alias("first_at"))
    return materialize.flush_choice(b, fx.moment(NOW), 60, 60).withColumn("first_at", fx.as_text("first_at"))


@query("SELECT topic, CAST(sum(bytes) AS BIGINT) AS bytes FROM rec GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def forced_flush(spark, d):
    return materialize.largest_buffer(fx.records(spark, d).groupBy("topic").agg(F.sum("bytes").alias("bytes")))


@query("SELECT strftime(ingest_time, '%Y-%m-%d') AS s3_key, count(*) AS segments, CAST(sum(byte_length) AS BIGINT) AS bytes FROM bat GROUP BY 1")
def segments_by_object(spark, d):
    return fx.batches(spark, d).groupBy(F.date_format("ingest_time", "yyyy-MM-dd").alias("s3_key")).agg(F.count("*").alias("segments"), F.sum("byte_length").alias("bytes"))


# --- schemas ------------------------------------------------------------------------------------------------

@query(""", ln AS (SELECT topic, 100 + writer_id % 3 AS schema_id, min(ts) AS created_at FROM rec GROUP BY ALL)
SELECT topic, schema_id, 'v' || (schema_id - 99) AS version FROM ln QUALIFY row_number() OVER (PARTITION BY topic ORDER BY created_at DESC, schema_id DESC) = 1""")
def latest_schema_per_topic(spark, d):
    links = fx.records(spark, d).groupBy("topic", (100 + F.col("writer_id") % 3).alias("schema_id")).agg(F.min("ts").alias("created_at"))
    schemas = spark.createDataFrame([(100, "v1"), (101, "v2"), (102, "v3")], "schema_id bigint, version string")
    return admin.latest_schema(links, schemas).select("topic", "schema_id", "version")


# --- access and keys ----------------------------------------------------------------------------------------

_ACLS = [("user:alice", "topic", "1", "read", "allow"), ("user:alice", "topic", "*", "*", "deny"), ("user:bob", "topic", "*", "*", "allow"), ("user:bob", "topic", "2", "write", "deny"), ("svc:etl", "topic", "3", "*", "deny"), ("svc:etl", "topic", "3", "read", "allow"), ("svc:etl", "group", "*", "read", "allow")]
_WHO = ["user:alice", "user:bob", "svc:etl", "admin", "admin:ops", "nobody"]


@query(f"""WITH acl(principal, resource_type, name, op, permission) AS (VALUES {_values(_ACLS)}), who(principal) AS (VALUES {_values([(w,) for w in _WHO])}),
req AS (SELECT CAST(n_nationkey * 100 + length(principal) AS BIGINT) AS request_id, principal, CASE WHEN n_nationkey % 5 = 4 THEN 'group' ELSE 'topic' END AS resource_type, CAST(n_nationkey % 4 AS VARCHAR) AS resource, CASE WHEN n_nationkey % 2 = 0 THEN 'read' ELSE 'write' END AS operation FROM nation, who),
hit AS (SELECT req.*, name, permission FROM req LEFT JOIN acl ON acl.principal = req.principal AND acl.resource_type = req.resource_type AND (op = '*' OR op = operation))
SELECT request_id, principal, resource_type, resource, operation, CASE WHEN principal = 'admin' OR starts_with(principal, 'admin:') THEN true
 WHEN bool_or(coalesce(name = resource AND permission = 'deny', false)) THEN false WHEN bool_or(coalesce(name = resource AND permission = 'allow', false)) THEN true
 WHEN bool_or(coalesce(name = '*' AND permission = 'deny', false)) THEN false ELSE bool_or(coalesce(name = '*' AND permission = 'allow', false)) END AS allowed
FROM hit GROUP BY request_id, principal, resource_type, resource, operation""")
def acl_check(spark, d):
    n = fx.table(spark, d, "nation")
    who = F.explode(F.array(*[F.lit(w) for w in _WHO])).alias("principal")
    req = n.select(who, "n_nationkey").select((F.col("n_nationkey") * 100 + F.length("principal")).cast("bigint").alias("request_id"), "principal", F.when(F.col("n_nationkey") % 5 == 4, "group").otherwise("topic").alias("resource_type"), (F.col("n_nationkey") % 4).cast("string").alias("resource"), F.when(F.col("n_nationkey") % 2 == 0, "read").otherwise("write").alias("operation"))
    return admin.check_access(req, spark.createDataFrame(_ACLS, "principal string, resource_type string, resource_name string, operation string, permission string"))


_KEYS = [("tb_0123456789abcdef0123456789abcdef_s1", None, None), ("tb_0123456789abcdef0123456789abcdee_s2", None, "2024-01-01 00:00:00"), ("tb_0123456789abcdef0123456789abcded_s3", "2024-01-19 00:00:00", None), ("tb_short_s", None, None), ("", None, None), ("tb_0123456789abcdef0123456789abcdec_s4", "2024-02-01 00:00:00", None)]


@query(f"""WITH k(api_key, expires_at, revoked_at) AS (VALUES {_values(_KEYS)}), x AS (SELECT *, regexp_extract(api_key, '^tb_([0-9a-f]{{32}})_(.+)$', 1) AS key_id FROM k)
SELECT api_key, key_id, CASE WHEN key_id = '' THEN 'invalid' WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN CAST(expires_at AS TIMESTAMP) <= TIMESTAMP '{NOW}' THEN 'expired' ELSE 'valid' END AS state FROM x""")
def api_key_state(spark, d):
    k = spark.createDataFrame(_KEYS, "api_key string, expires_at string, revoked_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))
    return admin.key_state(k, fx.moment(NOW)).select("api_key", "key_id", "state")


_NAMES = [("admin",), ("admin:ops",), ("user:alice",), ("svc:a:b",), ("plain",), (":x",), ("administrator",)]


@query(f"""WITH p(principal) AS (VALUES {_values(_NAMES)}) SELECT principal, principal = 'admin' OR starts_with(principal, 'admin:') AS is_admin,
 CASE WHEN strpos(principal, ':') > 0 THEN left(principal, strpos(principal, ':') - 1) ELSE principal END AS kind, CASE WHEN strpos(principal, ':') > 0 THEN substr(principal, strpos(principal, ':') + 1) END AS name FROM p""")
def principal_parts(spark, d):
    p = spark.createDataFrame(_NAMES, "principal string")
    c = F.col("principal")
    return p.select("principal", admin.is_admin(c).alias("is_admin"), admin.principal_type(c).alias("kind"), admin.principal_name(c).alias("name"))


@query("""WITH g(given) AS (VALUES ('FRANCE'), ('7'), ('none'), ('007')) SELECT given, coalesce(TRY_CAST(given AS BIGINT), n_nationkey) AS topic_id FROM g LEFT JOIN nation ON n_name = given""")
def resolve_topic(spark, d):
    names = spark.createDataFrame([("FRANCE",), ("7",), ("none",), ("007",)], "given string")
    return admin.resolve_topics(names, fx.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("topic_id")))


@query(f"SELECT topic, strftime(flush_ts, '%Y-%m-%d %H:%M:%S') AS flush FROM seg WHERE flush_ts >= TIMESTAMP '{NOW}' - to_hours(CASE WHEN topic = 'view' THEN 24 ELSE 168 END)")
def retention_filter(spark, d):
    topics = spark.createDataFrame([(t, 24 if t == "view" else 168) for t in fx.TOPICS], "topic string, retention_hours int")
    return admin.retained(fx.batches(spark, d), topics, fx.moment(NOW)).select("topic", fx.as_text("flush_ts").alias("flush"))


# --- invariants, on a history with planted faults -----------------------------------------------------------

_HIST = """, wr AS (SELECT topic, writer_id, CASE WHEN event_id % 501 = 7 THEN _offset + 1 WHEN event_id % 301 = 13 THEN greatest(_offset - 400, 0) ELSE _offset END AS "offset", event_id AS value, event_id * 2 AS start_time, event_id * 2 + 1 AS end_time, true AS success FROM log),
rd AS (SELECT topic, _offset // 40 AS seq, min(_offset) AS requested, list(CASE WHEN event_id % 333 = 5 THEN -event_id WHEN _offset % 90 = 3 THEN 424242 ELSE event_id END ORDER BY _offset) AS vals,
 CASE WHEN (_offset // 40) % 4 = 3 THEN 0 ELSE max(_offset) + 1 END AS hw FROM log WHERE _offset % 977 <> 40 GROUP BY topic, _offset // 40),
ob AS (SELECT topic, seq, requested + unnest(range(len(vals))) AS "offset", unnest(vals) AS value FROM rd)
"""


def _history(spark, d):
    log = fx.log(spark, d)
    fault = F.when(F.col("event_id") % 501 == 7, F.col("_offset") + 1).when(F.col("event_id") % 301 == 13, F.greatest(F.col("_offset") - 400, F.lit(0))).otherwise(F.col("_offset"))
    writes = log.select("topic", "writer_id", fault.alias("offset"), F.col("event_id").alias("value"), (F.col("event_id") * 2).alias("start_time"), (F.col("event_id") * 2 + 1).alias("end_time"), F.lit(True).alias("success"))
    value = F.when(F.col("event_id") % 333 == 5, -F.col("event_id")).when(F.col("_offset") % 90 == 3, F.lit(424242)).otherwise(F.col("event_id"))
    r = log.filter("_offset % 977 <> 40").withColumn("seq", F.floor(F.col("_offset") / 40)).groupBy("topic", "seq").agg(F.min("_offset").alias("requested_offset"), F.max("_offset").alias("_top"), F.sort_array(F.collect_list(F.struct("_offset", value.alias("v")))).alias("_v"))
    hw = F.when(F.col("seq") % 4 == 3, 0).otherwise(F.col("_top") + 1)
    return writes, r.select("topic", F.lit("r0").alias("reader_id"), "seq", "requested_offset", F.transform("_v", lambda x: x.v).alias("values"), hw.alias("high_watermark"))


@query(_HIST + "SELECT topic, \"offset\", value FROM wr ANTI JOIN ob USING (topic, \"offset\", value)")
def invariant_acked_visible(spark, d):
    return verify.lost_writes(*_history(spark, d)).select("topic", "offset", "value")


@query(_HIST + "SELECT topic, \"offset\", count(*) AS n FROM wr GROUP BY ALL HAVING count(*) > 1")
def invariant_unique_offsets(spark, d):
    return verify.shared_offsets(_history(spark, d)[0])


@query(_HIST + "SELECT topic, seq, before, hw AS high_watermark FROM (SELECT *, lag(hw) OVER (PARTITION BY topic ORDER BY seq) AS before FROM rd) WHERE hw < before")
def invariant_watermark_monotone(spark, d):
    return verify.falling_watermarks(_history(spark, d)[1]).drop("reader_id")


@query(_HIST + "SELECT topic, value, count(DISTINCT \"offset\") AS n FROM ob GROUP BY ALL HAVING count(DISTINCT \"offset\") > 1")
def invariant_no_duplicates(spark, d):
    return verify.duplicate_values(_history(spark, d)[1])


@query(_HIST + "SELECT topic, seq, expected, requested AS requested_offset FROM (SELECT *, lag(requested + len(vals)) OVER (PARTITION BY topic ORDER BY seq) AS expected FROM rd) WHERE requested <> expected")
def invariant_poll_contiguity(spark, d):
    return verify.poll_gaps(_history(spark, d)[1]).drop("reader_id")


@query(_HIST + "SELECT topic, \"offset\", before AS highest_before FROM (SELECT topic, \"offset\", max(\"offset\") OVER (PARTITION BY topic ORDER BY start_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM wr) WHERE before > \"offset\"")
def invariant_write_causal(spark, d):
    return verify.causal_violations(_history(spark, d)[0])


@query(_HIST + "SELECT topic, writer_id, before, \"offset\" FROM (SELECT *, lag(\"offset\") OVER (PARTITION BY topic, writer_id ORDER BY start_time, \"offset\") AS before FROM wr) WHERE \"offset\" <= before")
def invariant_monotone_sends(spark, d):
    return verify.unordered_sends(_history(spark, d)[0])


@query(_HIST + "SELECT DISTINCT topic, value FROM ob ANTI JOIN wr USING (topic, value)")
def invariant_no_phantoms(spark, d):
    return verify.phantoms(*_history(spark, d))


# --- reports and windows ------------------------------------------------------------------------------------

@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99, max(value) AS max, count(*) AS n FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return reports.latencies(fx.table(spark, d, "events"), "event_type", "value")


@query("""WITH s AS (SELECT user_id % 4 AS shard, event_type, CAST(sum(length(props)) AS BIGINT) AS bytes, min(event_id) / 10.0 AS a, max(event_id) / 10.0 AS b, max(value) AS p99 FROM events GROUP BY ALL)
SELECT event_type, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(max(b) - min(a) AS DOUBLE) AS seconds, max(p99) AS worst_p99, sum(bytes) / CAST(max(b) - min(a) AS DOUBLE) / 1048576 AS mib_per_s FROM s GROUP BY 1""")
def throughput_union_window(spark, d):
    e = fx.table(spark, d, "events")
    shards = e.groupBy((F.col("user_id") % 4).alias("shard"), "event_type").agg(F.sum(F.length("props")).alias("bytes"), (F.min("event_id") / 10).alias("start_s"), (F.max("event_id") / 10).alias("end_s"), F.max("value").alias("p99"))
    return reports.union_window(shards, "event_type")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM y GROUP BY user_id, s""")
def session_window_ext(spark, d):
    e = fx.table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "6 hours")).agg(F.count("*").alias("n")).select("user_id", fx.as_text("session_window.start").alias("started"), "n")


@query("SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY ALL")
def tumbling_ext(spark, d):
    e = fx.table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("t", "1 day")).agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("bytes")).select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", "bytes")


@query("SELECT event_type AS label, CAST(floor(value / 50) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def metrics_histogram(spark, d):
    return fx.table(spark, d, "events").groupBy(F.col("event_type").alias("label"), F.floor(F.col("value") / 50).alias("bucket")).agg(F.count("*").alias("n"))
