"""Catch-up: segments that the hot path has missed, claimed and written to the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import materialize
from ..sources.tables import LogTable


def catch_up(index: DataFrame, claims: DataFrame, table: LogTable, decode: Callable[[DataFrame], DataFrame], now: Column, epoch: int, rows: int = materialize.CLAIM_ROWS) -> DataFrame:
    """One round: drops stale claims, claims the first free segments, appends their records, completes the claims.

    decode turns segments of the index into rows with topic and batch_id. Returns the claims after the round;
    if the append fails none has changed, and a batch that is already in the table is only marked.
    """
    live = materialize.expire_claims(claims, now)
    mine = materialize.unclaimed(index, live, rows)
    table.append(decode(mine), epoch)
    done = mine.select("batch_id", "ingest_time", F.lit("completed").alias("status"), now.alias("claimed_at"))
    return live.select("batch_id", "ingest_time", "status", "claimed_at").unionByName(done)
