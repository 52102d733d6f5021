"""Seeded workload generators: seq, key and op as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _op(read_ratio: float, seed: int) -> Column:
    return F.when(F.rand(seed) < read_ratio, "GET").otherwise("PUT")


def uniform(spark: SparkSession, n: int, keyspace: int, read_ratio: float = 0.8, prefix: str = "key", seed: int = 1) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit(f"{prefix}:"), F.floor(F.rand(seed) * keyspace)).alias("key"), _op(read_ratio, seed + 1).alias("op"))


def zipf_cdf(spark: SparkSession, keyspace: int, skew: float = 1.07) -> DataFrame:
    """rank and cumulative probability; the last is 1 exactly."""
    w = spark.range(1, keyspace + 1, numPartitions=1).select(F.col("id").alias("rank"), F.pow(F.col("id"), F.lit(-skew)).alias("w"))
    cum = F.sum("w").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return w.select("rank", F.when(F.col("rank") == keyspace, F.lit(1.0)).otherwise(cum / F.sum("w").over(W.partitionBy())).alias("cdf"))


def zipf(spark: SparkSession, n: int, keyspace: int, read_ratio: float = 0.8, skew: float = 1.07, prefix: str = "key", seed: int = 1, buckets: int = 4_096) -> DataFrame:
    """Inverse-CDF sampling: draws meet the ranks of their bucket of probability."""
    cdf = zipf_cdf(spark, keyspace, skew).withColumn("lo", F.lag("cdf", 1, 0.0).over(W.orderBy("rank")))
    cdf = cdf.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") * buckets), F.least(F.floor(F.col("cdf") * buckets), F.lit(buckets - 1)))))
    draw = spark.range(n).select(F.col("id").alias("seq"), F.rand(seed).alias("u"), _op(read_ratio, seed + 1).alias("op")).withColumn("b", F.floor(F.col("u") * buckets))
    hit = draw.join(cdf, (draw["b"] == cdf["b"]) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("cdf")))
    return hit.select("seq", F.concat(F.lit(f"{prefix}:"), F.col("rank") - 1).alias("key"), "op")


def scan(spark: SparkSession, n: int, keyspace: int, prefix: str = "key", op: str = "GET") -> DataFrame:
    return spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit(f"{prefix}:"), F.col("id") % keyspace).alias("key"), F.lit(op).alias("op"))


def mixed(spark: SparkSession, n: int, keyspace: int, weights: tuple[float, ...] = (1.0, 1.0, 0.5), seed: int = 1) -> DataFrame:
    """Zipf reads, uniform writes and a scan, by weight; the scan's cursor moves only when it is chosen."""
    if not weights or sum(weights) <= 0:
        raise ValueError("a mixed workload needs components")
    total, u = sum(weights), F.rand(seed + 10)
    part = F.when(u < weights[0] / total, 0).when(u < (weights[0] + weights[1]) / total, 1).otherwise(2)
    pick = spark.range(n).select(F.col("id").alias("seq"), part.alias("part"))
    a = zipf(spark, n, keyspace, 0.95, 1.2, seed=seed).withColumn("part", F.lit(0))
    b = uniform(spark, n, keyspace, 0.1, seed=seed + 3).withColumn("part", F.lit(1))
    # the cursor: how often the scan was chosen before, counted within blocks and shifted by the blocks before
    c = pick.where("part = 2").withColumn("block", F.floor(F.col("seq") / 100_000))
    base = c.groupBy("block").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(W.orderBy("block")) - F.col("n")).select("block", "base")
    c = c.join(base, "block").withColumn("at", F.col("base") + F.row_number().over(W.partitionBy("block").orderBy("seq")) - 1)
    c = c.select("seq", F.concat(F.lit("key:"), F.col("at") % keyspace).alias("key"), F.lit("GET").alias("op"), "part")
    return pick.join(a.unionByName(b).unionByName(c), ["seq", "part"]).select("seq", "key", "op")


PRESETS = {
    "UNIFORM": lambda s, n, k, seed=1: uniform(s, n, k, seed=seed), "ZIPFIAN": lambda s, n, k, seed=1: zipf(s, n, k, seed=seed), "SEQUENTIAL_SCAN": lambda s, n, k, seed=1: scan(s, n, k),
    "READ_HEAVY": lambda s, n, k, seed=1: zipf(s, n, k, 0.95, 1.2, seed=seed), "WRITE_HEAVY": lambda s, n, k, seed=1: uniform(s, n, k, 0.1, seed=seed), "MIXED": lambda s, n, k, seed=1: mixed(s, n, k, seed=seed),
}
