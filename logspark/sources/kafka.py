"""Kafka topics of message envelopes. Needs Spark's Kafka package on the class path; the conversions don't."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schema import EVENT_SCHEMA

#: A message: its topic, how often it was tried and why it failed last, and the whole event.
MESSAGE = "topic string, attempts int, last_error string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_SCHEMA)


def envelopes(records: DataFrame) -> DataFrame:
    """Kafka records (topic, value, ...) -> columns of MESSAGE, `malformed` (the value, where it is no envelope)."""
    parsed = F.from_json(F.col("value").cast("string"), MESSAGE + ", __bad string", {"columnNameOfCorruptRecord": "__bad"})
    rows = records.select("topic", F.col("value").cast("string").alias("value"), parsed.alias("m"))
    names = [f.name for f in EVENT_SCHEMA]
    bad = F.col("m").isNull() | F.col("m.__bad").isNotNull()
    return rows.select("topic", F.coalesce("m.attempts", F.lit(0)).alias("attempts"), "m.last_error", *[f"m.{n}" for n in names], F.when(bad, F.col("value")).alias("malformed"))


def records(messages: DataFrame) -> DataFrame:
    """Messages -> topic, key (the stream's, so that a stream stays in order), value."""
    key = text.stream_key("tenant_id", "stream_labels")
    names = ["topic", "attempts", "last_error", *[f.name for f in EVENT_SCHEMA]]
    return messages.select("topic", key.alias("key"), F.to_json(F.struct(*names)).alias("value"))


def read_topic(spark: SparkSession, servers: str, topics: str, streaming: bool = True, **options: str) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return envelopes(reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).options(**options).load())


def write_topic(messages: DataFrame, servers: str) -> None:
    records(messages).write.format("kafka").option("kafka.bootstrap.servers", servers).save()
