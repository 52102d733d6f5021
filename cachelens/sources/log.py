"""The access log and the other inputs, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> Column:
    """Epoch milliseconds of a zone-less timestamp column, whatever the time zone of the session."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def from_events(events: DataFrame) -> DataFrame:
    """Events read as cache operations: a row for each GET, PUT or DELETE of user:<id>."""
    op = F.when(F.col("event_type").isin("view", "click"), "GET").when(F.col("event_type").isin("signup", "purchase"), "PUT").otherwise("DELETE")
    return events.select(
        "event_id", millis("ts").cast("long").alias("ts"), F.concat(F.lit("user:"), "user_id").alias("key"), op.alias("op"),
        F.when(F.col("event_type") == "purchase", F.lit(DAY).cast("long")).alias("ttl"), F.octet_length("props").cast("long").alias("size_bytes"),
        F.col("value").alias("latency_ms"), F.col("props").alias("value"),
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def parse_static_nodes(raw: Column) -> Column:
    """`id:host:port:weight` entries, separated by commas, as an array of structs; weight defaults to 1."""
    entry = F.transform(F.filter(F.transform(F.split(raw, ","), F.trim), lambda e: e != ""), lambda e: F.split(e, ":"))
    return F.transform(entry, lambda p: F.struct(F.trim(p[0]).alias("node_id"), F.get(p, F.lit(1)).alias("host"), F.get(p, F.lit(2)).try_cast("int").alias("port"), F.coalesce(F.get(p, F.lit(3)).try_cast("double"), F.lit(1.0)).alias("weight")))


STATIC_NODES = "node-1:cache-1:7001:1,node-2:cache-2:7002:1,node-3:cache-3:7003:1"


def nodes(spark: SparkSession, raw: str = STATIC_NODES) -> DataFrame:
    return spark.range(1).select(F.inline(parse_static_nodes(F.lit(raw)))).withColumn("status", F.lit("HEALTHY"))


def validate(op: Column, key: Column, value: Column, ttl: Column) -> Column:
    """The error code of an operation, or null: keys must be non-empty, PUT needs a value, a ttl must be positive."""
    bad = F.coalesce(F.length(key) == 0, F.lit(True)) | ((op == "PUT") & value.isNull()) | F.coalesce(ttl <= 0, F.lit(False))
    return F.when(bad, "VALIDATION_ERROR").when(~op.isin("GET", "PUT", "DELETE"), "VALIDATION_ERROR")


#: Fixed values of the interface: error codes and their HTTP status.
STATUS = {"KEY_NOT_FOUND": 404, "VALIDATION_ERROR": 400, "NODE_UNAVAILABLE": 503, "NO_HEALTHY_NODES": 503, "CAPACITY_EXCEEDED": 507, "CONFIGURATION_ERROR": 500, "REPLICATION_ERROR": 500, "SNAPSHOT_ERROR": 500, "RECOVERY_ERROR": 500, "INTERNAL_ERROR": 500}


def status_of(code: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))[code], F.lit(500))
