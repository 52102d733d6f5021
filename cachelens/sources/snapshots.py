"""Snapshots of cache state: JSON files (gzip), a manifest with checksums, retention, recovery."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "key string, value string, version long, created_at long, updated_at long, last_accessed_at long, frequency long, expires_at long, size_bytes long"
MANIFEST = "snapshot_id string, node string, created_at long, entry_count long, size_bytes long, checksum string"


class SnapshotError(RuntimeError):
    pass


def check_id(snapshot_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", snapshot_id):
        raise SnapshotError(f"bad snapshot id: {snapshot_id!r}")
    return snapshot_id


def checksum(entries: DataFrame) -> DataFrame:
    """One row: count, bytes and an order-free checksum, the sum of row digests."""
    row = F.sha2(F.to_json(F.struct(*(f.split()[0] for f in ENTRY.split(", "))), {"ignoreNullFields": "false"}), 256)
    digest = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return entries.agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.sha2(F.coalesce(F.sum(digest), F.lit(0)).cast("string"), 256).alias("checksum"))


def take(entries: DataFrame, root: str, snapshot_id: str, node: str, created_at: int, compress: bool = True) -> DataFrame:
    """Writes the entries and then a manifest row: a snapshot without a manifest doesn't exist."""
    check_id(snapshot_id)
    e = entries.selectExpr(*(f"CAST({c.split()[0]} AS {c.split()[1]})" for c in ENTRY.split(", ")))
    e.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip" if compress else "none").json(f"{root}/{snapshot_id}/entries")
    written = entries.sparkSession.read.schema(ENTRY).json(f"{root}/{snapshot_id}/entries")
    row = checksum(written).select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(node).alias("node"), F.lit(created_at).cast("long").alias("created_at"), F.col("n").alias("entry_count"), F.col("bytes").alias("size_bytes"), "checksum")
    row.coalesce(1).write.mode("overwrite").json(f"{root}/{snapshot_id}/manifest")
    return row


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """All manifests, newest first."""
    return spark.read.schema(MANIFEST).json(f"{root}/*/manifest").orderBy(F.desc("created_at"), F.desc("snapshot_id"))


def restore(spark: SparkSession, root: str, snapshot_id: str | None = None) -> DataFrame:
    """The entries of a snapshot (the newest by default); raises if the checksum differs."""
    found = catalog(spark, root).where(F.col("snapshot_id") == check_id(snapshot_id)) if snapshot_id else catalog(spark, root)
    row = found.first()
    if row is None:
        raise SnapshotError("no such snapshot")
    entries = spark.read.schema(ENTRY).json(f"{root}/{row['snapshot_id']}/entries")
    if checksum(entries).first()["checksum"] != row["checksum"]:
        raise SnapshotError(f"checksum of {row['snapshot_id']} differs")
    return entries


def expired_ids(manifest: DataFrame, keep: int = 5) -> DataFrame:
    """The snapshots beyond the newest `keep` of each node."""
    from pyspark.sql import Window as W

    r = F.row_number().over(W.partitionBy("node").orderBy(F.desc("created_at"), F.desc("snapshot_id")))
    return manifest.withColumn("r", r).where(F.col("r") > keep).drop("r")


def delete(spark: SparkSession, root: str, snapshot_id: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{check_id(snapshot_id)}")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def prune(spark: SparkSession, root: str, keep: int = 5) -> list[str]:
    """Deletes what retention gives up; a manifest has a row for each snapshot, so few ids reach the driver."""
    gone = [r["snapshot_id"] for r in expired_ids(catalog(spark, root), keep).collect()]
    for s in gone:
        delete(spark, root, s)
    return gone


def recovered(entries: DataFrame, now: int) -> DataFrame:
    """Entries as a restart applies them: version 1, no use, created now, the remaining time to live (not below 0)."""
    t = F.lit(now).cast("long")
    left = F.greatest(F.col("expires_at") - t, F.lit(0).cast("long"))
    return entries.select("key", "value", F.lit(1).cast("long").alias("version"), t.alias("created_at"), t.alias("updated_at"), t.alias("last_accessed_at"), F.lit(0).cast("long").alias("frequency"), F.when(F.col("expires_at").isNotNull(), t + left).alias("expires_at"), "size_bytes")


def recover(spark: SparkSession, root: str, node: str, now: int) -> tuple[DataFrame, DataFrame]:
    """What a node holds after a restart, and the report of it (one row).

    The store starts empty; the newest snapshot's entries are applied again. Without a snapshot the store
    stays empty and the report is sound; one that can't be verified leaves it empty, too, and is an error.
    """
    empty, name, error = spark.createDataFrame([], ENTRY), None, None
    try:
        found = catalog(spark, root).first() if exists(spark, root) else None
        entries = recovered(restore(spark, root, found["snapshot_id"]), now).select(empty.columns) if found else empty
        name = found["snapshot_id"] if found else None
    except SnapshotError as e:
        entries, error = empty, str(e)
    row = entries.agg(F.count("*").alias("entries_restored"))
    errors = F.array(F.lit(error)) if error else F.array().cast("array<string>")
    return entries, row.select(
        F.lit(node).alias("node"), F.lit(now).cast("long").alias("finished_at"), F.lit(name).cast("string").alias("snapshot_restored"), "entries_restored",
        F.lit(0).cast("long").alias("operations_replayed"), F.lit(error is None).alias("integrity_verified"), errors.alias("errors"),
    )


def assert_healthy(report_: DataFrame) -> None:
    """Raises unless the recovery was verified: until then a node takes no traffic."""
    r = report_.first()
    if not r["integrity_verified"]:
        raise SnapshotError(f"recovery of {r['node']} is not verified: {'; '.join(r['errors'])}")


def exists(spark: SparkSession, root: str) -> bool:
    """Whether any snapshot has a manifest."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/manifest")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def report(entries: DataFrame, now: int) -> DataFrame:
    return entries.agg(F.count("*").alias("entries_restored"), F.count_if(F.col("expires_at") <= now).alias("expired_on_arrival"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_restored")).withColumn("operations_replayed", F.lit(0).cast("long"))
