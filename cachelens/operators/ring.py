"""Weighted consistent hashing: points, owners, replicas, balance, rebalancing and failover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import M, ring_hash

VIRTUAL, SHIFT = 128, 22


def virtual_nodes(weight: Column, base: int = VIRTUAL) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(base) * weight + 0.5).cast("int"))


def points(nodes: DataFrame, base: int = VIRTUAL) -> DataFrame:
    """node_id, idx and hash of each virtual node; the ring has as many rows as the cluster has of these."""
    at = nodes.select("node_id", F.explode(F.sequence(F.lit(0), virtual_nodes(F.col("weight"), base) - 1)).alias("idx"))
    return at.withColumn("hash", ring_hash(F.concat("node_id", F.lit("#"), "idx")))


def _arcs(ring: DataFrame) -> DataFrame:
    """lo < hash <= hi belongs to node_id; the part after the last point to the first one's node."""
    order = W.orderBy("hash", "node_id", "idx")  # ring points only
    arcs = ring.select("node_id", F.lag("hash", 1, -1).over(order).alias("lo"), F.col("hash").alias("hi"))
    wrap = ring.agg(F.min(F.struct("hash", "node_id", "idx"))["node_id"].alias("node_id"), F.max("hash").alias("lo")).select("node_id", "lo", F.lit(M - 1).cast("long").alias("hi"))
    return arcs.unionByName(wrap).where("hi > lo")


def owners(keys: DataFrame, ring: DataFrame, name: str = "owner") -> DataFrame:
    """keys (a column key) with the node of the first point at or after the key's hash.

    Arcs are spread over the 1024 buckets they cross, which turns the range join into a hash
    join; keys are never shuffled when the ring is small enough to broadcast.
    """
    arcs = _arcs(ring).withColumn("b", F.explode(F.sequence(F.shiftright(F.greatest("lo", F.lit(0).cast("long")), SHIFT), F.shiftright("hi", SHIFT))))
    k = keys.withColumn("h", ring_hash(F.col("key")))
    k = k.withColumn("b", F.shiftright("h", SHIFT))
    return k.join(arcs, (k["b"] == arcs["b"]) & (k["h"] > arcs["lo"]) & (k["h"] <= arcs["hi"])).drop("b", "h", "lo", "hi").withColumnRenamed("node_id", name)


def replicas(keys: DataFrame, ring: DataFrame, n: int) -> DataFrame:
    """key and nodes: the first n distinct nodes clockwise from the key. Resolved once for each arc, then joined.

    A point looks at the points after it on the ring, laid out twice, as many as it takes: the reach
    doubles until all have seen n nodes.
    """
    size, nodes = ring.agg(F.count("*"), F.countDistinct("node_id")).first()
    want, reach = min(n, nodes), 8 * max(1, n)
    laps = ring.select("node_id", "idx", "hash", F.explode(F.array(F.lit(0), F.lit(1))).alias("lap"))
    while True:
        ahead = W.orderBy("lap", "hash", "node_id", "idx").rowsBetween(0, min(reach, max(0, size - 1)))  # ring points only
        lists = laps.withColumn("nodes", F.slice(F.array_distinct(F.collect_list("node_id").over(ahead)), 1, max(1, n))).where("lap = 0")
        if reach >= size or lists.where(F.size("nodes") < want).isEmpty():
            break
        reach *= 2
    at = lists.select(F.concat_ws("#", "node_id", "idx").alias("node_id"), F.lit(0).alias("idx"), "hash", "nodes")
    return owners(keys, at.select("node_id", "idx", "hash"), "point").join(at.select(F.col("node_id").alias("point"), "nodes"), "point").drop("point")


def movement(keys: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """total, moved, ratio of keys that change owner, and the share that theory expects."""
    both = owners(owners(keys, before, "was"), after, "now")
    n = before.agg(F.countDistinct("node_id").alias("nb")).crossJoin(after.agg(F.countDistinct("node_id").alias("na")))  # one row
    got = both.agg(F.count("*").alias("total"), F.count_if(F.col("was") != F.col("now")).alias("moved"))
    return got.crossJoin(n).select("total", "moved", F.round(F.col("moved") / F.col("total"), 6).alias("ratio"), F.round(1 / F.greatest("na", "nb", F.lit(1)), 6).alias("expected"))


def route(replicas_: DataFrame, dead: list[str]) -> DataFrame:
    """The first candidate that isn't dead; null if none is left."""
    alive = F.filter("nodes", lambda x: ~x.isin(dead) if dead else F.lit(True))
    return replicas_.select("key", F.get(alive, F.lit(0)).alias("target"), (F.get(alive, F.lit(0)) != F.get("nodes", F.lit(0))).alias("failed_over"))


def candidates(replica_lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, place and the node's row for each candidate id in the order of the ring; unknown and dead nodes go.

    nodes is a row a node, so the join is left to its size.
    """
    ids = replica_lists.select("key", F.posexplode("nodes").alias("place", "node_id"))
    return ids.join(nodes.where("status <> 'DEAD'"), "node_id").select("key", "place", "node_id", *(c for c in nodes.columns if c != "node_id"))
