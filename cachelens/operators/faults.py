"""Fault commands by node and the state that they leave; validation of commands; automatic switches that are pinned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the interface.
COMMANDS, POLICIES = ("KILL", "RESTART", "DELAY_REPLICATION", "DROP_MESSAGES"), ("LRU", "LFU", "TINY_LFU", "FIFO")
DELAY_MS, DROP = 2_000, 0.5


def command_error(type_: Column, policy: Column | None = None) -> Column:
    """The error code of a fault or policy command, or null."""
    bad = ~F.coalesce(type_.isin(*COMMANDS), F.lit(False))
    if policy is not None:
        bad = bad | ~F.coalesce(policy.isin(*POLICIES), F.lit(False))
    return F.when(bad, "VALIDATION_ERROR")


def states(commands: DataFrame) -> DataFrame:
    """commands (node, at, type, duration_ms, drop_rate) with the state after each: killed, delay_ms, drop.

    A restart revives the node; a delay or a drop rate holds until the next one of its kind. The rate
    lies in 0 .. 1. Commands of one time apply by the order of their types.
    """
    w = W.partitionBy("node").orderBy("at", "type").rowsBetween(W.unboundedPreceding, 0)

    def last(on: Column, value: Column, default: Column) -> Column:
        return F.coalesce(F.last(F.when(on, value), ignorenulls=True).over(w), default)

    kind = F.col("type")
    rate = F.least(F.greatest(F.coalesce("drop_rate", F.lit(DROP)), F.lit(0.0)), F.lit(1.0))
    return commands.where(command_error(kind).isNull()).select(
        "node", "at", "type", last(kind.isin("KILL", "RESTART"), kind == "KILL", F.lit(False)).alias("killed"),
        last(kind == "DELAY_REPLICATION", F.coalesce("duration_ms", F.lit(DELAY_MS)).cast("long"), F.lit(0).cast("long")).alias("delay_ms"), last(kind == "DROP_MESSAGES", rate, F.lit(0.0)).alias("drop"),
    )


def outages(commands: DataFrame) -> DataFrame:
    """node, start and end (null: still down) of each time that a node is killed."""
    s = states(commands).where(F.col("type").isin("KILL", "RESTART"))
    w = W.partitionBy("node").orderBy("at", "type")
    turn = s.withColumn("was", F.lag("killed", 1, False).over(w)).where("killed <> was")
    return turn.withColumn("end", F.lead("at").over(w)).where("killed").select("node", F.col("at").alias("start"), "end")


def pinned(decisions: DataFrame, orders: DataFrame, tick_ms: int) -> DataFrame:
    """decisions (tick, policy, ...) with auto and policy as orders (at, kind, policy) leave them.

    `pin` forces its policy and stops automatic switches, `force` switches once, `resume` lets the
    decisions take over again. An order counts from the first tick that ends after it.
    """
    o = orders.select((F.floor(F.col("at") / tick_ms)).alias("tick"), F.struct("at", "kind", F.col("policy").alias("forced")).alias("o"))
    per = o.groupBy("tick").agg(F.max("o").alias("o"))  # the newest order of a tick
    w = W.orderBy("tick").rowsBetween(W.unboundedPreceding, 0)  # a row a tick
    both = decisions.join(per, "tick", "left").withColumn("last", F.last("o", ignorenulls=True).over(w))
    held = F.coalesce(F.col("last.kind") == "pin", F.lit(False))
    once = F.coalesce(F.col("o.kind") == "force", F.lit(False))
    return both.withColumn("auto", ~held).withColumn("policy", F.when(held | once, F.col("last.forced")).otherwise(F.col("policy"))).drop("o", "last")
