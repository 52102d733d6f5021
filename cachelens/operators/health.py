"""Node health from polls, and operations gated by outages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def timeline(polls: DataFrame, suspect: int = 2, dead: int = 5) -> DataFrame:
    """polls (node, at, ok) with the run of misses and the status: unchanged below `suspect` misses, a success heals."""
    w = W.partitionBy("node").orderBy("at")
    run = polls.withColumn("g", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = run.withColumn("misses", F.sum((~F.col("ok")).cast("int")).over(W.partitionBy("node", "g").orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    status = F.when(F.col("misses") >= dead, "DEAD").when(F.col("misses") >= suspect, "SUSPECT").otherwise("HEALTHY")
    return run.select("node", "at", "ok", "misses", status.alias("status"))


def gated(log: DataFrame, outages: DataFrame) -> DataFrame:
    """The log with down: whether its node was killed at the time (start inclusive, end exclusive)."""
    per = outages.groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("__outs"))  # a row a node
    down = F.exists("__outs", lambda o: (F.col("ts") >= o["start"]) & (F.col("ts") < o["end"]))
    return log.join(per, "node", "left").withColumn("down", F.coalesce(down, F.lit(False))).drop("__outs")


def polls_of(log: DataFrame, node: Column, ok: Column, every_ms: int) -> DataFrame:
    """Polls derived from a log: a poll for each node and interval that has rows succeeds if ok holds for any."""
    return log.groupBy(node.alias("node"), F.floor(F.col("ts") / every_ms).alias("at")).agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("ok"))
