"""Helpers that several training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark's readers touch the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that spark.checkpoint.dir names. Where it is unset, a local master gets a temporary folder; a cluster has none that all can read."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="scratch-"))
        base = _OWN_DIR[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tidy(spark: SparkSession) -> None:
    """Once the driver's heap has grown to half of its bound: plans, broadcasts and shuffle files of finished steps go, and the heap shrinks again."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        spark._jvm.java.lang.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bounds of an Arrow batch. A single longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def for_workers(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Settings for Python workers: where they import from, and bounds for the rows and bytes of an Arrow batch, so that batches of long texts stay small beside a Python worker's memory. Lower bounds that the session had before stay."""
    # Python workers find this package where the driver has it, unless it was shipped (--py-files) or installed.
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    in_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, bound in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key, own = f"spark.sql.execution.arrow.{name}", f"cachelens.own.{name}"
        if spark.conf.get(own, None) is None:
            spark.conf.set(own, spark.conf.get(key))
        was = in_bytes(spark.conf.get(own))
        spark.conf.set(key, str(min(was, bound) if was > 0 else bound))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
