"""Count-Min sketch by expressions: cells, estimates, over-count, aging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a

WIDTH, DEPTH, TOP = 2_048, 4, 65_535


def cells(key: Column, width: int = WIDTH, depth: int = DEPTH) -> Column:
    """Array of the key's cell in each row."""
    return F.array(*(F.pmod(fnv1a(key, r), F.lit(width)).cast("int") for r in range(depth)))


def sketch(keys: DataFrame, n: str = "n") -> DataFrame:
    """row, cell and saturated count, from keys with their counts."""
    each = keys.select(n, F.posexplode(cells(F.col("key"))).alias("row", "cell"))
    return each.groupBy("row", "cell").agg(F.least(F.sum(n), F.lit(TOP)).alias("count"))


def estimates(keys: DataFrame, table: DataFrame) -> DataFrame:
    each = keys.select("key", F.posexplode(cells(F.col("key"))).alias("row", "cell"))
    return each.join(table, ["row", "cell"]).groupBy("key").agg(F.min("count").alias("estimate"))


def aged(hits: DataFrame, threshold: int) -> DataFrame:
    """row, cell, count after halving all cells at every threshold-th increment.

    hits: key and seq (1-based). Counts collapse to (row, cell, epoch); a cell folds
    over all epochs, the open one isn't halved.
    """
    e = hits.withColumn("epoch", F.floor((F.col("seq") - 1) / threshold).cast("int")).groupBy("key", "epoch").agg(F.count("*").alias("n"))
    per = e.select("epoch", "n", F.posexplode(cells(F.col("key"))).alias("row", "cell")).groupBy("row", "cell", "epoch").agg(F.sum("n").alias("n"))
    closed = hits.agg(F.floor(F.max("seq") / threshold).cast("int").alias("closed"))  # one row
    maps = per.groupBy("row", "cell").agg(F.map_from_entries(F.collect_list(F.struct("epoch", "n"))).alias("m")).crossJoin(F.broadcast(closed))
    seen = F.transform(F.sequence(F.lit(0), F.col("closed")), lambda i: F.struct(i.alias("i"), F.coalesce(F.element_at("m", i), F.lit(0).cast("long")).alias("n")))
    fold = F.aggregate(seen, F.lit(0).cast("long"), lambda v, x: F.when(x["i"] < F.col("closed"), F.floor(F.least(F.lit(TOP), v + x["n"]) / 2)).otherwise(F.least(F.lit(TOP), v + x["n"])).cast("long"))
    return maps.select("row", "cell", fold.alias("count")).where("count > 0")
