"""Cluster metrics: roll-ups, nearest-rank percentiles, trailing rates, arg-bests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import nearest_ranks

POLICIES, STATUSES = ("LRU", "LFU", "TINY_LFU"), ("JOINING", "HEALTHY", "SUSPECT", "DEAD", "LEAVING")


def percentiles(x: str) -> list[Column]:
    """Nearest-rank p50, p95, p99 and the maximum; 0 without samples."""
    disc = [F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})"), F.lit(0.0)).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return [*disc, F.coalesce(F.max(x), F.lit(0.0)).alias("max")]


def percentiles_by(df: DataFrame, by: str, x: str) -> DataFrame:
    """by, p50, p95, p99 and max of x, by nearest rank; 0 without samples."""
    got = df.select(by).distinct().join(nearest_ranks(df, by, x, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), by, "left")
    return got.select(by, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p50", "p95", "p99", "max")))


def last_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The newest n rows, by a top-n that keeps n rows in each task."""
    return df.orderBy(F.desc(order)).limit(n)


def trailing_rate(df: DataFrame, by: str, ts: str, window_ms: int, segments: int = 8) -> DataFrame:
    """df with rate: rows of the trailing window, the bounds included, per second.

    Time is cut in segments of some windows each, so that a hot key is many partitions; a row
    that the next segment looks back at goes there as well, without a result.
    """
    size = window_ms * segments
    at = F.floor(F.col(ts) / size)
    seen = df.withColumn("__own", at).withColumn("__in", F.explode(F.when(F.col(ts) >= (at + 1) * size - window_ms, F.array(at, at + 1)).otherwise(F.array(at))))
    w = W.partitionBy(by, "__in").orderBy(ts).rangeBetween(-window_ms, 0)
    out = seen.withColumn("rate", F.round(F.count("*").over(w) / F.lit(window_ms / 1000), 6))
    return out.where("__own = __in").drop("__own", "__in")


def node_snapshots(replayed: DataFrame, seconds: float) -> DataFrame:
    """One snapshot a node from a replayed log with a column node."""
    df = replayed.groupBy("node").agg(F.count_if("hit").alias("hits"), F.count_if("miss").alias("misses"), F.count("*").alias("n"), F.sum("size_bytes").alias("memory"))
    df = df.join(nearest_ranks(replayed, "node", "latency_ms", {"p99": 0.99}).drop("max"), "node", "left")
    return df.withColumn("rps", F.round(F.col("n") / F.lit(seconds), 6))


def cluster_summary(snapshots: DataFrame) -> DataFrame:
    """Sums, the ratio of sums and the worst p99; one row of zeros for no snapshot."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    hits, misses = F.sum("hits"), F.sum("misses")
    return snapshots.agg(
        F.count("*").alias("nodes"), zero(hits).alias("hits"), zero(misses).alias("misses"), zero(F.sum("memory")).alias("memory"), F.round(F.coalesce(F.sum("rps"), F.lit(0.0)), 4).alias("rps"),
        F.round(F.coalesce(F.try_divide(hits, hits + misses), F.lit(0.0)), 6).alias("hit_ratio"), F.coalesce(F.max("p99"), F.lit(0.0)).alias("worst_p99"),
    )


def distribution(df: DataFrame, col: str, values: tuple[str, ...]) -> DataFrame:
    """A count for each value of a fixed list, zeros included, as columns."""
    return df.agg(*(F.count_if(F.col(col) == v).alias(v.lower()) for v in values))
