"""Replication: events, targets, faults, last-writer-wins merges, acknowledgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import ring_hash


def events(replayed: DataFrame) -> DataFrame:
    """Writes, and deletes that met an entry, as replication events."""
    return replayed.where((F.col("op") == "PUT") | F.col("deleted")).select("event_id", F.col("node").alias("source"), "key", "op", "value", "version", "ts")


def targets(events_: DataFrame, replica_lists: DataFrame) -> DataFrame:
    """One row for each event and target: the key's replicas but the source."""
    return events_.join(replica_lists, "key").withColumn("target", F.explode(F.array_except("nodes", F.array("source")))).drop("nodes")


def addressed_to(events_: DataFrame, replica_lists: DataFrame, node: str) -> DataFrame:
    """The events that a node applies, of a topic that all nodes read: those with the node among their targets and another source."""
    mine = replica_lists.where(F.array_contains("nodes", node)).select("key")
    return events_.where(F.col("source") != node).join(mine, "key", "left_semi")


def delivered(sent: DataFrame, drop_percent: int, delay_ms: int | Column = 2_000) -> DataFrame:
    """sent with applied_at: null for the share that is dropped, delayed for the rest; a hash of event and target decides."""
    h = F.pmod(ring_hash(F.concat_ws("@", F.col("event_id"), F.col("target"))), F.lit(100))
    return sent.withColumn("applied_at", F.when(h >= drop_percent, F.col("ts") + delay_ms))


def faulted(sent: DataFrame, drop_percent: int, delay_ms: int | Column = 2_000) -> DataFrame:
    """What arrives."""
    return delivered(sent, drop_percent, delay_ms).where("applied_at is not null")


def merge(rows: DataFrame, *by: str) -> DataFrame:
    """Last writer wins: the highest version for each key, ties by the earlier event."""
    best = F.max_by(F.struct("op", "value", "version", "event_id"), F.struct("version", -F.col("event_id")))
    return rows.groupBy(*by, "key").agg(best.alias("w")).select(*by, "key", "w.op", "w.value", "w.version", "w.event_id")


def _with_arrivals(sent: DataFrame, arrived: DataFrame | None) -> DataFrame:
    return sent if arrived is None else sent.join(arrived.select("event_id", "target", "applied_at"), ["event_id", "target"], "left")


def acks(sent: DataFrame, arrived: DataFrame | None = None, timeout_ms: int = 5_000) -> DataFrame:
    """Per event: targets, targets that acknowledged in time, and whether all did. sent is what delivered() gives, unless arrivals come apart."""
    sent = _with_arrivals(sent, arrived)
    in_time = F.count_if(F.col("applied_at") - F.col("ts") <= timeout_ms)
    return sent.groupBy("event_id").agg(F.count("*").alias("wanted"), in_time.alias("acked")).withColumn("complete", F.col("acked") == F.col("wanted"))


def pending_at(sent: DataFrame, arrived: DataFrame | None, now: Column, timeout_ms: int = 5_000) -> DataFrame:
    """The count of events that wait at a time: sent, not timed out, and not all acknowledged. Arrivals as for acks()."""
    open_ = _with_arrivals(sent, arrived).where((F.col("ts") <= now) & (F.col("ts") + timeout_ms > now))
    per = open_.groupBy("event_id").agg(F.count("*").alias("wanted"), F.count_if(F.col("applied_at") <= now).alias("done"))
    return per.agg(F.count_if(F.col("done") < F.col("wanted")).alias("pending"))


def resolved(local: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Which of incoming (key, version, op, ...) a replica applies over its own entries (key, version, expires_at), with applies and reason.

    An event of a higher version wins, and so does one whose key has no live entry here; else the local entry stays.
    """
    mine = local.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("key", F.col("version").alias("__v"))
    reason = F.when(F.col("__v").isNull(), "absent").when(F.col("version") > F.col("__v"), "newer").otherwise("stale")
    return incoming.join(mine, "key", "left").withColumn("reason", reason).withColumn("applies", F.col("reason") != "stale").drop("__v")
