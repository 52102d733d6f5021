"""Streaming forms of the batch queries: file source, event time, availableNow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable, scratch_path
from ..sources.log import from_events


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with event time `at`. A stream reads folders or patterns; the pattern matches file and folder alike."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return from_events(s).withColumn("at", F.timestamp_millis("ts"))


def drained(stream: DataFrame, *key: str) -> DataFrame:
    """Runs a streaming query to the end of its input and gives what it wrote to a table in the shared folder.

    Without a key the stream appends. With one it updates: every micro-batch writes the rows that it
    changed, and the newest one of each key holds. A batch that is run again replaces its own files.
    """
    spark = stream.sparkSession
    path, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    schema = stream.schema
    # a table without rows, for a stream that never has a batch
    spark.createDataFrame([], schema).write.parquet(f"{path}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(write).outputMode("update" if key else "append").option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.option("basePath", path).schema(schema.add("batch", "long")).parquet(path)
    if not key:
        return out.drop("batch")
    rest = [c for c in schema.names if c not in key and c != "batch"]
    return out.groupBy(*key).agg(F.max(F.struct("batch", *rest)).alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))


def stats(stream: DataFrame) -> DataFrame:
    """Counts by operation."""
    return stream.groupBy("op").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def ticks(stream: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling ticks; rows later than the watermark are dropped, and ticks behind it leave the state."""
    return stream.withWatermark("at", late).groupBy(F.window("at", size).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("op") == "GET").alias("reads")).select(F.unix_millis("w.start").alias("tick"), "n", "reads")


def last_writes(stream: DataFrame) -> DataFrame:
    """The newest write of each key, updated."""
    w = stream.where("op = 'PUT'")
    return w.groupBy("key").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


def key_counters(stream: DataFrame) -> DataFrame:
    """Reads and writes of each key."""
    return stream.groupBy("key").agg(F.count_if(F.col("op") == "GET").alias("reads"), F.count_if(F.col("op") == "PUT").alias("writes"))


def deduplicated(stream: DataFrame, late: str = "40 days") -> DataFrame:
    """At-least-once input made once: repeated event ids within the watermark go."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def acknowledged(sent: DataFrame, acks: DataFrame, timeout: str = "5 seconds") -> DataFrame:
    """Writes with their acknowledgement, null if none came in time: a stream-stream outer join. acks: ack_id, ack_at."""
    a = acks.withWatermark("ack_at", "10 seconds")
    s = sent.withWatermark("at", "10 seconds")
    return s.join(a, F.expr(f"event_id = ack_id AND ack_at >= at AND ack_at <= at + INTERVAL {timeout}"), "leftOuter")


def cache_reads(stream: DataFrame) -> DataFrame:
    """Hits, misses and expirations as a stream, from the state of each key: what time it expires and whether it is there.

    Rows of a micro-batch are taken in the order of their event ids; state is three numbers a key.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        there, expires, version = state.get if state.exists else (False, None, 0)
        hits = misses = expirations = 0
        rows = pd.concat(list(parts)).sort_values("event_id")
        for op, ts, ttl in zip(rows["op"], rows["ts"].tolist(), rows["ttl"].tolist(), strict=True):
            if op == "PUT":
                there, expires, version = True, None if pd.isna(ttl) else ts + int(ttl), (version if there else 0) + 1
            elif op == "DELETE":
                there = False
            elif there and (expires is None or expires > ts):
                hits += 1
            else:
                expirations += there
                there, misses = False, misses + 1
        state.update((there, expires, version))
        yield pd.DataFrame([(key[0], hits, misses, expirations)], columns=["key", "hits", "misses", "expirations"])

    importable(stream.sparkSession)
    cols = stream.select("key", "event_id", "op", "ts", "ttl")
    return cols.groupBy("key").applyInPandasWithState(step, "key string, hits long, misses long, expirations long", "there boolean, expires long, version long", "append", "NoTimeout")
