"""Streaming ingest: payload files in, parsed events out, with retries, dead letters and replay.

The checkpoint is the log of what was read; each micro-batch goes through the same projections as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lifecycle import after_failure
from ..operators.stages import Stage, promote, run_stages, violation
from ..schema import EVENT_SCHEMA, canonical
from ..sources.kafka import MESSAGE


def message_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """JSON messages of a topic's folder; a file that appears is read once."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files).json(folder)


def payload_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """payload, one for each line of the folder's files, and `arrival`, which orders them."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(folder)
    return lines.select(F.unix_millis("_metadata.file_modification_time").alias("arrival"), F.col("value").alias("payload"))


def event_of(messages: DataFrame) -> DataFrame:
    """Messages -> events that know how often they were tried."""
    return canonical(messages.withColumn("attempts", F.coalesce("attempts", F.lit(0))), "attempts")


def parsed(events: DataFrame, stages: list[Stage], reserved: list[str], allow: list[str], deny: list[str]) -> DataFrame:
    """Stages, promotion and limits: adds `broken`, the stage or rule that an event fails, or null."""
    done = promote(run_stages(events, stages), reserved, allow, deny)
    return done.withColumn("broken", F.coalesce("failed", F.when(~F.col("dropped"), violation())))


def ingest(
    messages: DataFrame, to_events: Callable[[DataFrame], DataFrame], process: Callable[[DataFrame], DataFrame],
    events_path: str, retry_path: str, dead_path: str, checkpoint: str, max_attempts: int = 3,
) -> StreamingQuery:
    """Runs until all that is there is read (availableNow). `to_events` makes events of what is read: event_of of
    messages, or a payload reader of payloads. Good events are appended to events_path; failed ones, with all that
    they hold, go to retry_path with one more attempt, or after max_attempts to dead_path. A batch that is run again after a
    crash replaces its own files, each batch having a folder, so nothing is written twice."""

    def batch(rows: DataFrame, number: int) -> None:
        out = process(to_events(rows))
        if "attempts" not in out.columns:  # payloads come for the first time
            out = out.withColumn("attempts", F.lit(0))
        out = out.persist()  # three sinks read it; executors that are lost compute their part again
        names = EVENT_SCHEMA.fieldNames()
        out.where("broken IS NULL AND NOT dropped").select(*names).write.mode("overwrite").parquet(f"{events_path}/batch={number}")
        bad = after_failure(out.where("broken IS NOT NULL").withColumn("ok", F.lit(False)), max_attempts)
        for to, path in (("retry", retry_path), ("dead", dead_path)):
            rows = bad.where(F.col("to") == to).select(F.lit(to).alias("topic"), "attempts", F.col("broken").alias("last_error"), *names)
            rows.write.mode("overwrite").json(f"{path}/batch={number}")
        out.unpersist()

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(events: DataFrame, within: str = "10 minutes") -> DataFrame:
    """A stream without events that come again within the given time: state is bounded by the watermark."""
    timed = events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", within)
    keyed = timed.withColumn("identity", F.sha2(F.concat_ws("\x1f", "tenant_id", F.col("ts_ns").cast("string"), "body", "trace_id", "span_id", F.to_json("stream_labels")), 256))
    return keyed.dropDuplicatesWithinWatermark(["identity"]).drop("identity", "event_time")
