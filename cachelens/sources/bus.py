"""A message bus over any of Spark's stream formats: topics of JSON messages, keyed for order.

With Kafka on the class path the format is "kafka" and options name the brokers; a folder of
JSON lines (format "json") carries the same rows key, value, topic, timestamp without brokers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

ROW = "key string, value string, topic string, timestamp timestamp"


def message(df: DataFrame, topic: str, key: str | Column, at: Column | None = None) -> DataFrame:
    """Rows as messages of a topic: all columns as JSON under the key, so that one key's messages keep their order."""
    value = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    return df.select((F.col(key) if isinstance(key, str) else key).cast("string").alias("key"), value.alias("value"), F.lit(topic).alias("topic"), (at if at is not None else F.current_timestamp()).alias("timestamp"))


def publish(messages: DataFrame, format: str = "json", **options: str) -> None:
    """Appends messages to the bus; equal keys go to one file or partition, in the order of their times."""
    out = messages.repartition("topic", "key").sortWithinPartitions("topic", "key", "timestamp") if format != "kafka" else messages
    out.write.format(format).options(**options).mode("append").save()


def publishing(messages: DataFrame, checkpoint: str, format: str = "json", **options: str) -> DataStreamWriter:
    """The same for a stream."""
    return messages.writeStream.format(format).options(**options).option("checkpointLocation", checkpoint).outputMode("append")


def subscribed(spark: SparkSession, topics: list[str], format: str = "json", **options: str) -> DataFrame:
    """The stream of key, value, topic, timestamp of some topics."""
    s = spark.readStream.format(format).options(**options)
    if format == "kafka":
        return s.option("subscribe", ",".join(topics)).load().selectExpr("CAST(key AS STRING)", "CAST(value AS STRING)", "topic", "timestamp")
    return s.schema(ROW).load().where(F.col("topic").isin(*topics))


def parsed(messages: DataFrame, schema: str) -> DataFrame:
    """The messages' fields, with topic and timestamp; a value that is no JSON object is dropped and stops nothing."""
    whole = F.try_parse_json("value").isNotNull() & F.ltrim(F.col("value")).startswith("{")
    got = messages.where(F.coalesce(whole, F.lit(False))).select("topic", "timestamp", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("m"))
    return got.select("m.*", "topic", "timestamp")


def handled(messages: DataFrame, handlers: dict[str, list[Callable[[DataFrame, int], None]]], checkpoint: str) -> DataStreamWriter:
    """Every handler of a topic gets each micro-batch of its messages, in the order in which they were registered."""

    def each(batch: DataFrame, number: int) -> None:
        for topic, fs in handlers.items():
            for f in fs:
                f(batch.where(F.col("topic") == topic), number)

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
