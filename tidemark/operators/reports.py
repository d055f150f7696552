"""Latency and throughput reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latencies(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Exact p50 and p99, maximum and count."""
    return samples.groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.99)).alias("p99"), F.max(value).alias("max"), F.count("*").alias("n"))


def union_window(shards: DataFrame, key: str) -> DataFrame:
    """Throughput of several shards: all their bytes over the time from the first start to the last end (seconds)."""
    took = F.max("end_s") - F.min("start_s")
    return shards.groupBy(key).agg(F.sum("bytes").cast("bigint").alias("bytes"), took.alias("seconds"), F.max("p99").alias("worst_p99"), (F.sum("bytes") / F.greatest(took, F.lit(1e-9)) / (1 << 20)).alias("mib_per_s"))
