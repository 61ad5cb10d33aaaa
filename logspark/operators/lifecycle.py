"""Queues, retries, admission and retention as operations on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def queue_partition(key: Column, partitions: int = 8) -> Column:
    """CRC-32 of the key; the empty key goes to 0."""
    return F.when(key == "", F.lit(0)).otherwise(F.pmod(F.crc32(key), F.lit(partitions))).cast("int")


def enqueue(events: DataFrame, topic: str, partitions: int = 8) -> DataFrame:
    """Events -> topic, partition, offset, key, ingest_seq. Offsets count arrivals in a partition, from 0.

    A partition is numbered hour by hour (see chunks.numbered), not in one task."""
    key = text.stream_key("tenant_id", "stream_labels")
    rows = events.select("ingest_seq", key.alias("key"), queue_partition(key, partitions).alias("partition"), F.floor(F.col("ingest_seq") / 4096).alias("part"))
    sums = rows.groupBy("partition", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("partition").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("partition", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lower"))
    own = F.row_number().over(Window.partitionBy("partition", "part").orderBy("ingest_seq")) - 1
    placed = rows.withColumn("own", own).join(sums, ["partition", "part"])
    return placed.select(F.lit(topic).alias("topic"), "partition", (F.col("own") + F.col("lower")).cast("long").alias("offset"), "key", "ingest_seq")


def lag(messages: DataFrame, commits: DataFrame) -> DataFrame:
    """messages (topic, partition, offset), commits (topic, partition, committed) -> high watermark and lag, never below 0."""
    top = messages.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("high"))
    committed = commits.groupBy("topic", "partition").agg(F.max("committed").alias("committed"))
    joined = top.join(committed, ["topic", "partition"], "left").withColumn("committed", F.coalesce("committed", F.lit(0)))
    return joined.withColumn("lag", F.greatest(F.lit(0), F.col("high") - F.col("committed")))


def poll(messages: DataFrame, commits: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest messages from each partition's committed offset on, in order of arrival and offset."""
    done = commits.groupBy("topic", "partition").agg(F.max("committed").alias("committed"))
    waiting = messages.join(done, ["topic", "partition"], "left").where("offset >= coalesce(committed, 0)").drop("committed")
    return waiting.orderBy("ingest_seq", "partition", "offset").limit(limit)


def replay(messages: DataFrame, limit: int = 0) -> DataFrame:
    """Messages from the first on; commits are not looked at."""
    rows = messages.orderBy("ingest_seq", "partition", "offset")
    return rows.limit(limit) if limit else rows


def committed(polled: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits after these messages are handled: one more than the highest offset, never less than before."""
    new = polled.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("committed"))
    both = commits.select("topic", "partition", "committed").unionByName(new)
    return both.groupBy("topic", "partition").agg(F.max("committed").alias("committed"))


def after_failure(messages: DataFrame, max_attempts: int = 3) -> DataFrame:
    """messages with `ok` and `attempts` -> with `to`: done, retry, or the dead letters after max_attempts failures."""
    tried = F.when(F.col("ok"), F.col("attempts")).otherwise(F.col("attempts") + 1)
    to = F.when(F.col("ok"), "done").when(F.col("attempts") + 1 >= max_attempts, "dead").otherwise("retry")
    return messages.withColumns({"to": to, "attempts": tried})


def over_budget(max_body: int = 262_144) -> Column:
    """Whether an event's texts exceed its body limit and 128 bytes for each label."""
    texts = [F.col(c) for c in ("tenant_id", "severity", "trace_id", "span_id")]
    maps = [F.col(c) for c in ("stream_labels", "resource_attrs", "log_attrs", "parsed_fields")]
    return text.stored_bytes(F.col("body"), texts, maps) > max_body + 128 * F.size("stream_labels")


def retention(segments: DataFrame, tenants: DataFrame, now: Column, default_days: int = 7) -> DataFrame:
    """segments (tenant_id, bucket, ends, chunks), tenants (tenant_id, retention_days, protected, legal_hold) -> with
    expired: it ended before the retention period, and the tenant is neither protected nor on hold. Unknown tenants
    have the default. The tenants' table is joined by key and as large as Spark finds it."""
    joined = segments.join(tenants, "tenant_id", "left")
    days = F.coalesce("retention_days", F.lit(default_days))
    kept = F.coalesce("protected", F.lit(False)) | F.coalesce("legal_hold", F.lit(False))
    return joined.withColumn("expired", ~kept & (F.col("ends") < now - F.make_dt_interval(days)))


def retention_report(decided: DataFrame) -> DataFrame:
    """tenant_id, scanned, deleted_segments, deleted_chunks."""
    return decided.groupBy("tenant_id").agg(
        F.count("*").alias("scanned"), F.count_if("expired").alias("deleted_segments"),
        F.coalesce(F.sum(F.when(F.col("expired"), F.col("chunks"))), F.lit(0)).alias("deleted_chunks"),
    )


def with_tenant(rows: DataFrame, tenants: DataFrame) -> DataFrame:
    """Rows with their tenant's columns and `known`, by one join; the columns are null for unknown tenants."""
    marked = tenants.withColumn("known", F.lit(True))
    return rows.join(marked, "tenant_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
