"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only.

A record goes to the shard with the largest -weight / ln(u), where u in (0, 1)
comes from a hash of its key and the shard's name. A new shard only takes the
records it wins, so no record moves between the old shards.

Defined results: a null key hashes as the word null; equal keys share a shard;
equal rows are counted once and dealt consecutive slots, so one key may hold any share
of the rows; null texts have size 1 and the checksum of no bytes; texts of any length are summed whole; an empty table gives an empty result; columns named like the
output's are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows for which a bucket of slots is planned.
BUCKET_ROWS = 50_000
#: Copies of a row that one output row of the first explode stands for.
RUN = 4_096


def _score(key: Column, shard: int, weight: float, seed: str) -> Column:
    hex13 = F.substring(F.md5(F.concat(F.lit(f"{seed}:{shard}:"), key)), 1, 13)
    u = (F.conv(hex13, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.lit(-float(weight)) / F.ln(u)


def shard_of(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    """The shard that wins key; ties go to the lower shard."""
    name = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [F.struct(_score(name, i, w, seed).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    return (-F.greatest(*scores)["i"] if len(scores) > 1 else F.lit(0)).cast("int")


def assign(df: DataFrame, key: str, text: str, weights: Sequence[float], seed: str = "shard", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc key, size, text_crc32, law, shard, slot and grown_shard (with one more shard of weight 1) of each row.

    Texts end in the first projection: only key, size and checksum are shuffled.
    Slots are numbered within buckets of a hash of key, size and checksum and shifted by the rows
    of lower buckets, so no task sees a whole shard.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n_buckets = max(1, -(-df.count() // bucket_rows))
    rows = df.select(F.col(key).alias("k"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"))
    rows = rows.groupBy("k", "size", "crc").agg(F.count("*").alias("n"))
    rows = rows.withColumns({"shard": shard_of(F.col("k"), weights, seed), "grown": shard_of(F.col("k"), [*weights, 1.0], seed)})
    name = F.concat_ws(":", F.coalesce(F.col("k").cast("string"), F.lit("null")), "size", "crc")
    rows = rows.withColumn("bucket", (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % n_buckets).cast("int"))
    per = rows.groupBy("bucket", "shard").agg(F.sum("n").alias("rows"))  # as many rows as buckets times shards
    base = per.select("bucket", "shard", (F.sum("rows").over(W.partitionBy("shard").orderBy("bucket")) - F.col("rows")).alias("base"))
    inner = W.partitionBy("bucket", "shard").orderBy("k", "crc", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    dealt = rows.withColumn("first", F.sum("n").over(inner) - F.col("n")).join(base, ["bucket", "shard"])
    runs = dealt.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    ids = runs.withColumn("i", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("n")) - 1)))
    return ids.select(
        F.col("k").alias(key), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        (F.col("base") + F.col("first") + F.col("i")).cast("long").alias("slot"), F.col("grown").alias("grown_shard"),
    )
