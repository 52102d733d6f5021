"""Cache state without a simulator: hits, expiry, versions and frequencies of an unbounded cache by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def expired(expires_at: Column, now: Column) -> Column:
    """The boundary is inclusive; null never expires."""
    return F.coalesce(expires_at <= now, F.lit(False))


def replay(log: DataFrame) -> DataFrame:
    """The log with hit, expired (the read that finds an entry dead), miss, seg, version, frequency, created_at and deleted.

    The last write before a row decides what a read sees. Removals cut a key's rows into
    segments, within which versions and frequencies run. All windows share
    the key's partition, so the log is shuffled once.
    """
    by = W.partitionBy("key").orderBy("event_id")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op") != "GET", F.struct(F.col("event_id").alias("id"), "op", (F.col("ts") + F.col("ttl")).alias("exp"))), ignorenulls=True).over(before)
    df = log.withColumn("m", last)
    read = (F.col("op") == "GET") & F.coalesce(F.col("m.op") == "PUT", F.lit(False))
    dead = expired(F.col("m.exp"), F.col("ts"))
    df = df.withColumns({"hit": read & ~dead, "late": read & dead})
    first = F.row_number().over(W.partitionBy("key", "m.id", "late").orderBy("event_id")) == 1
    df = df.withColumn("expired", F.col("late") & first)
    df = df.withColumn("seg", F.coalesce(F.sum(((F.col("op") == "DELETE") | F.col("expired")).cast("int")).over(before), F.lit(0)))
    run = W.partitionBy("key", "seg").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({
        "version": F.sum((F.col("op") == "PUT").cast("int")).over(run), "frequency": F.sum(F.col("hit").cast("int")).over(run),
        "created_at": F.min(F.when(F.col("op") == "PUT", F.col("ts"))).over(run), "accessed_at": F.max(F.when(F.col("hit"), F.col("ts"))).over(run),
    })
    return df.withColumns({"miss": (F.col("op") == "GET") & ~F.col("hit"), "deleted": (F.col("op") == "DELETE") & (F.col("version") > 0)}).drop("late")


def final_state(log: DataFrame) -> DataFrame:
    """The entries that the store holds after the log, expired ones that no read met included."""
    last = F.row_number().over(W.partitionBy("key").orderBy(F.desc("event_id")))
    put = F.last(F.when(F.col("op") == "PUT", F.struct(F.col("ts").alias("updated_at"), (F.col("ts") + F.col("ttl")).alias("expires_at"), "value", "size_bytes")), ignorenulls=True).over(W.partitionBy("key", "seg").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0))
    end = replay(log).withColumn("p", put).withColumn("r", last).where("r = 1 and op <> 'DELETE' and not expired and version > 0")
    return end.select("key", "p.value", "version", "created_at", "p.updated_at", F.coalesce("accessed_at", "created_at").alias("last_accessed_at"), "frequency", "p.expires_at", "p.size_bytes")


def live_at(state: DataFrame, now: Column) -> DataFrame:
    return state.where(~expired(F.col("expires_at"), now))


def has(asked: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """key, present and removed of the asked keys: whether a live entry is there, and whether the question removes an expired one. It counts as neither hit nor miss."""
    held = state.select("key", expired(F.col("expires_at"), now).alias("__dead"))
    return asked.select("key").distinct().join(held, "key", "left").select("key", F.coalesce(~F.col("__dead"), F.lit(False)).alias("present"), F.coalesce("__dead", F.lit(False)).alias("removed"))


def metadata(state: DataFrame, now: Column) -> DataFrame:
    """All but the value of the live entries."""
    return live_at(state, now).drop("value")


def cleared(log: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """The replays before and after the store is cleared at event id `at`. Counters run on over both: a clear resets none."""
    return replay(log.where(F.col("event_id") < at)), replay(log.where(F.col("event_id") >= at))


def counters(replayed: DataFrame, *by: str) -> DataFrame:
    """hits, misses, expirations, writes, deletes and the hit ratio, 0 where nothing was read."""
    n = {"hits": "hit", "misses": "miss", "expirations": "expired", "deletes": "deleted"}
    df = replayed.groupBy(*by).agg(*(F.count_if(c).alias(k) for k, c in n.items()), F.count_if(F.col("op") == "PUT").alias("writes"))
    return df.withColumn("hit_ratio", F.round(F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)), 6))
