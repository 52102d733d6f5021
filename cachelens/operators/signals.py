"""Workload signals by tick and the policy they call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .order import BUCKET, numbered

TICK, HISTORY, ALPHA = 86_400_000, 2_000, 0.25
#: Ticks that an exponential mean looks back at: (1 - ALPHA) ** REACH is below the precision of a double.
REACH = 200


def samples(replayed: DataFrame, tick_ms: int = TICK, bucket: int = BUCKET) -> DataFrame:
    """Reads and writes with tick and a gapless seq, numbered within ranges of event ids."""
    s = replayed.where("op <> 'DELETE'").withColumn("tick", F.floor(F.col("ts") / tick_ms))
    return numbered(s, bucket=bucket)


def gini(counts: Column) -> Column:
    """Of an array of counts, clamped to 0..1; 0 for an empty one."""
    n, total = F.size(counts), F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)
    weighted = F.aggregate(F.transform(F.sort_array(counts), lambda x, i: (i + 1) * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    g = F.try_divide(2 * weighted, n * total) - F.try_divide(n + F.lit(1.0), n)
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), g))).otherwise(F.lit(0.0))


def history(s: DataFrame, size: int = HISTORY) -> DataFrame:
    """tick, key and count within the last `size` samples at the end of each tick.

    Samples and the ends of ticks meet by blocks of `size` places: a window lies in two of them.
    """
    ends = s.groupBy(F.col("tick").alias("t")).agg(F.max("seq").alias("e"))
    ends = ends.withColumn("block", F.explode(F.array(F.floor(F.col("e") / size), F.floor(F.col("e") / size) - 1)))
    near = s.select("key", "seq", F.floor(F.col("seq") / size).alias("block"))
    in_window = (F.col("seq") <= F.col("e")) & (F.col("seq") > F.col("e") - size)
    return near.join(ends, "block").where(in_window).groupBy(F.col("t").alias("tick"), "key").agg(F.count("*").alias("n"))


def ema(values: Column, alpha: float = ALPHA) -> Column:
    """Exponential mean of an array in order. The first value seeds it, 0 if it is null; a later null feeds the mean again."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), F.coalesce(x, F.lit(0.0))).when(x.isNull(), a).otherwise(alpha * x + (1 - alpha) * a))


def steps(s: DataFrame) -> DataFrame:
    """tick, and the share of samples whose key's last number follows that of the sample before by one, up or down."""
    digits = F.regexp_extract_all("key", F.lit("[0-9]+"), F.lit(0))
    nums = s.select("tick", "bucket", "seq", F.get(F.reverse(digits), F.lit(0)).cast("long").alias("num")).where("num is not null")
    last = nums.groupBy("bucket").agg(F.max_by("num", "seq").alias("tail")).withColumn("carry", F.lag("tail").over(W.orderBy("bucket")))  # a row a bucket
    prev = F.coalesce(F.lag("num").over(W.partitionBy("bucket").orderBy("seq")), F.col("carry"))
    step = nums.join(last.select("bucket", "carry"), "bucket").withColumn("step", F.coalesce(F.abs(F.col("num") - prev) == 1, F.lit(False)))
    return step.groupBy("tick").agg(F.round(F.count_if("step") / F.count("*"), 6).alias("sequential"))


def by_tick(replayed: DataFrame, tick_ms: int = TICK, bucket: int = BUCKET) -> DataFrame:
    """The signals at the end of each tick that has samples; one without any would leave all of them as they were."""
    s = stored(samples(replayed, tick_ms, bucket).select("tick", "bucket", "seq", "key", "op", "hit"), "samples")
    base = s.groupBy("tick").agg(F.count_if("hit").alias("hits"), F.count_if(F.col("op") == "GET").alias("reads"), F.count_if(F.col("op") == "PUT").alias("writes"), F.max("seq").alias("samples"))
    base = base.select("tick", "samples", F.try_divide("hits", "reads").alias("hit_rate"), (F.col("writes") / (F.col("reads") + F.col("writes"))).alias("write_ratio"))
    # a row a tick; what lies further back has a weight below rounding
    recent = W.orderBy("tick").rowsBetween(1 - REACH, 0)
    for c in ("hit_rate", "write_ratio"):
        fed = F.transform(F.collect_list(F.struct(F.col(c).alias("x"))).over(recent), lambda v: v["x"])  # a list of plain values drops nulls
        base = base.withColumn(f"{c}_ema", F.round(ema(fed), 6))
    h = history(s).groupBy("tick").agg(F.round(gini(F.collect_list("n")), 6).alias("skew"), F.round(F.count("*") / F.sum("n"), 6).alias("working_set"))
    out = base.join(h, "tick").join(steps(s), "tick", "left")
    return out.select("tick", "samples", F.round(F.coalesce("hit_rate", F.lit(0.0)), 6).alias("hit_rate"), F.round("write_ratio", 6).alias("write_ratio"), "hit_rate_ema", "write_ratio_ema", "skew", "working_set", F.coalesce("sequential", F.lit(0.0)).alias("sequential"))


def decide(memory: Column, sequential: Column, reads: Column, skew: Column, writes: Column) -> tuple[Column, Column]:
    """Policy and the number of the rule that chose it; the first that holds."""
    rules = ((memory >= 0.85, "TINY_LFU"), (sequential >= 0.5, "LRU"), ((reads >= 0.7) & (skew >= 0.4), "LFU"), (writes >= 0.6, "LRU"))
    policy, rule = F.lit("TINY_LFU"), F.lit(5)
    for i, (c, p) in reversed(list(enumerate(rules, 1))):
        policy, rule = F.when(c, p).otherwise(policy), F.when(c, i).otherwise(rule)
    return policy, rule


def switches(decisions: DataFrame, tick_ms: int = TICK, least: int = 200, cooldown_ms: int = 15_000, start: str = "LRU") -> DataFrame:
    """The switches that guards let pass, as an ordered fold over the ticks."""
    ticks = F.sort_array(F.collect_list(F.struct("tick", "samples", "policy", "rule")))
    none = F.from_json(F.lit("[]"), "array<struct<tick:bigint,from:string,to:string,rule:int>>")
    seed = F.struct(F.lit(start).alias("p"), F.lit(None).cast("long").alias("at"), none.alias("out"))

    def fold(a: Column, x: Column) -> Column:
        now = x["tick"] * tick_ms
        go = (x["samples"] >= least) & (x["policy"] != a["p"]) & F.coalesce(now - a["at"] >= cooldown_ms, F.lit(True))
        row = F.struct(x["tick"].alias("tick"), a["p"].alias("from"), x["policy"].alias("to"), x["rule"].alias("rule"))
        return F.when(go, F.struct(x["policy"].alias("p"), now.alias("at"), F.concat(a["out"], F.array(row)).alias("out"))).otherwise(a)

    return decisions.agg(F.aggregate(ticks, seed, fold)["out"].alias("s")).select(F.inline("s"))


def detail(by_tick_: DataFrame, switched: DataFrame, start: str = "LRU", auto: bool = True, kept: int = 200) -> DataFrame:
    """One row: current_policy, auto_switch, the last tick's signals, the count of switches and the newest of them as JSON."""
    newest = switched.orderBy(F.desc("tick")).limit(kept)
    rows = F.sort_array(F.collect_list(F.struct("tick", "from", "to")))  # kept at most
    log = newest.agg(F.coalesce(F.max_by("to", "tick"), F.lit(start)).alias("current_policy"), F.to_json(rows).alias("history"))
    last = by_tick_.orderBy(F.desc("tick")).limit(1).crossJoin(switched.agg(F.count("*").alias("switches"))).crossJoin(log)  # one row each
    return last.select("current_policy", F.lit(auto).alias("auto_switch"), *by_tick_.columns, "switches", "history")
