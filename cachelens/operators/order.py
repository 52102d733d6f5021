"""Places in a global order without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ids for which a bucket is planned; a bucket is the most that one task numbers.
BUCKET = 1 << 17


def numbered(df: DataFrame, by: str = "event_id", name: str = "seq", bucket: int = BUCKET) -> DataFrame:
    """df with `name`, its gapless place (from 1) by a unique integer id, and `bucket`, the range of ids it lies in.

    Rows are numbered within ranges of ids and shifted by the rows of lower ranges, so no task
    sees more ids than a bucket has.
    """
    cut = df.withColumn("bucket", F.floor(F.col(by) / bucket))
    per = cut.groupBy("bucket").agg(F.count("*").alias("n"))
    base = per.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("__base"))  # a row a bucket
    own = F.row_number().over(W.partitionBy("bucket").orderBy(by))
    return cut.withColumn("__rn", own).join(base, "bucket").withColumn(name, F.col("__base") + F.col("__rn")).drop("__rn", "__base")


def nearest_ranks(df: DataFrame, by: str, x: str, shares: dict[str, float], buckets: int = 1_024) -> DataFrame:
    """by, a column for each share with its nearest-rank percentile of x, and max; groups without a value are left out.

    Values fall into equal ranges between the least and the greatest of their group; the counts of ranges
    tell which one holds a rank, and only values of that range are ordered. Equal values are counted first.
    """
    v = df.where(F.col(x).isNotNull()).groupBy(by, F.col(x).alias("v")).agg(F.count("*").alias("n"))
    ends = v.groupBy(by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))).otherwise(F.lit(0))
    held = v.join(F.broadcast(ends), by).withColumn("b", place.cast("int"))  # a row a group
    per = held.groupBy(by, "b", "total", "hi").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy(by).orderBy("b"))  # as many rows as ranges
    want = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.greatest(F.ceil(F.lit(p) * F.col("total")), F.lit(1)).alias("rank")) for k, p in shares.items())))
    hit = per.withColumn("upto", upto).select(by, "b", "hi", F.col("n").alias("m"), "upto", want.alias("w")).where("w.rank <= upto and w.rank > upto - m")
    hit = hit.select(by, "b", "hi", "w.name", (F.col("w.rank") - F.col("upto") + F.col("m")).alias("rank"))
    run = held.select(by, "b", "v", "n").join(F.broadcast(hit.select(by, "b").distinct()), [by, "b"])  # as many rows as groups and shares
    run = run.withColumn("run", F.sum("n").over(W.partitionBy(by, "b").orderBy("v")))
    got = run.join(F.broadcast(hit), [by, "b"]).where(F.col("run") >= F.col("rank")).groupBy(by, "name", "hi").agg(F.min("v").alias("v"))
    return got.groupBy(by).agg(*(F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in shares), F.max("hi").alias("max"))
