"""Log to table, once: claims, committer leases, watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Claims go stale after this many seconds; batches of one catch-up round.
CLAIM_TTL_S, CLAIM_ROWS = 300, 100


def unclaimed(index: DataFrame, claims: DataFrame, rows: int = CLAIM_ROWS) -> DataFrame:
    """The first segments, by start, that nobody has claimed."""
    return index.join(claims, ["batch_id", "ingest_time"], "left_anti").orderBy("start_offset", "batch_id").limit(rows)


def expire_claims(claims: DataFrame, now: Column, seconds: int = CLAIM_TTL_S) -> DataFrame:
    """Claims less those that have been pending too long."""
    stale = (F.col("status") == "pending") & (F.col("claimed_at") < now - F.expr(f"INTERVAL {seconds} SECONDS"))
    return claims.filter(~stale)


def mark_completed(claims: DataFrame, done: DataFrame) -> DataFrame:
    """Claims (batch_id, status) with done batches completed, be they claimed before or not."""
    flagged = done.select("batch_id").distinct().withColumn("_done", F.lit(True))
    return claims.join(flagged, "batch_id", "full_outer").select("batch_id", F.when(F.col("_done"), "completed").otherwise(F.col("status")).alias("status"))


def acquire(leases: DataFrame, now: Column) -> DataFrame:
    """Adds granted_epoch to requests (holder, epoch, lease_expiry of the present lease; asked_by): null if refused."""
    free = F.col("holder").isNull()
    live = F.col("lease_expiry") > now
    epoch = F.when(free, 1).when(~live, F.col("epoch") + 1).when(F.col("holder") == F.col("asked_by"), F.col("epoch"))
    return leases.withColumn("granted_epoch", epoch.cast("bigint"))


def next_epoch(holder: str | None, epoch: int, expiry: float, asked_by: str, now: float) -> int | None:
    """The same rule for one lease, as the sink's driver uses it."""
    if holder is None:
        return 1
    if expiry <= now:
        return epoch + 1
    return epoch if holder == asked_by else None


def after_watermark(segments: DataFrame, watermarks: DataFrame, key: str = "topic") -> DataFrame:
    """Segments that the table doesn't hold yet; a topic without watermark has none of them."""
    return segments.join(watermarks.select(key, "watermark"), key, "left").filter(F.col("watermark").isNull() | (F.col("batch_id") > F.col("watermark"))).drop("watermark")


def merge_watermarks(old: DataFrame, written: DataFrame, key: str = "topic") -> DataFrame:
    """Each topic's highest batch so far; topics of either side stay."""
    new = written.groupBy(key).agg(F.max("batch_id").alias("_new"))
    return old.join(new, key, "full_outer").select(key, F.greatest("watermark", "_new").alias("watermark"))


def contiguous_watermark(index: DataFrame, written: DataFrame, key: str = "topic") -> DataFrame:
    """The batch below which nothing is missing, so that a failed older batch is never skipped."""
    gaps = index.join(written.select(key, "batch_id"), [key, "batch_id"], "left_anti").groupBy(key).agg(F.min("batch_id").alias("_gap"))
    top = index.groupBy(key).agg(F.max("batch_id").alias("_top"))
    return top.join(gaps, key, "left").select(key, F.coalesce(F.col("_gap") - 1, F.col("_top")).alias("watermark"))


def flush_choice(buffers: DataFrame, now: Column, max_bytes: int, max_seconds: int) -> DataFrame:
    """Adds due to table buffers (bytes, first_at): large enough, or old enough."""
    old = F.col("first_at") <= now - F.expr(f"INTERVAL {max_seconds} SECONDS")
    return buffers.withColumn("due", (F.col("bytes") >= max_bytes) | old)


def largest_buffer(buffers: DataFrame, key: str = "topic") -> DataFrame:
    """The buffer that goes first when all together are too large; of equal ones the first by name."""
    return buffers.orderBy(F.desc("bytes"), key).limit(1)
