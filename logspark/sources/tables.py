"""Event tables on shared storage, and events made from the driver's tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schema import EVENT_SCHEMA, canonical


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by day, sorted in each file so that row groups can be skipped by tenant and time. `stream_key` and the
    hour's `bucket` are stored with the events, for searches by summaries."""
    added = {"stream_key": text.stream_key("tenant_id", "stream_labels"), "bucket": text.bucket(F.col("ts")), "day": F.to_date("ts")}
    rows = events.select(*EVENT_SCHEMA.fieldNames()).withColumns(added)
    dealt = rows.repartition("day", F.pmod(F.xxhash64("tenant_id", "ts_ns", "body"), F.lit(16)))
    dealt.sortWithinPartitions("day", "tenant_id", "ts").write.mode(mode).option("compression", "zstd").partitionBy("day").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event table with `stream_key`, `bucket` and `day`; conditions on the day leave out whole folders."""
    return spark.read.parquet(path)


def write_summaries(summaries: DataFrame, path: str, mode: str = "append") -> None:
    """Chunk summaries beside their events, by day."""
    summaries.write.mode(mode).option("compression", "zstd").partitionBy("day").parquet(path)


def write_tokens(tokens: DataFrame, path: str, mode: str = "append") -> None:
    """The tokens of chunks by day, sorted in each file so that row groups can be skipped by token."""
    rows = tokens.repartition("day", F.pmod(F.xxhash64("token"), F.lit(16))).sortWithinPartitions("day", "tenant_id", "token")
    rows.write.mode(mode).option("compression", "zstd").partitionBy("day").parquet(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A folder that all executors share: in spark.checkpoint.dir, or in local mode a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/logs-{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: there is no folder that all executors share")
    folder = tempfile.mkdtemp(prefix=f"logs-{name}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def write_requests_json(df: DataFrame, path: str) -> None:
    """Any table as JSON lines, appended: audit records, query results."""
    df.write.mode("append").json(path)


def _dealt(events: DataFrame) -> DataFrame:
    """The raw events over all cores: a file of few row groups is read by few tasks, which then would do all the work of
    making, parsing and splitting bodies alone, however many cores there are."""
    return events.repartition("event_id")


def driver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as log events with JSON bodies."""
    e = _dealt(spark.read.parquet(f"{sf_dir}/events.parquet"))
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING").otherwise("info")
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    k = F.regexp_replace("props", "[^0-9]", "")
    body = F.concat(
        F.lit('{"service":"'), "event_type", F.lit('","level":"'), level, F.lit('","user":"u'), F.col("user_id").cast("string"),
        F.lit('","status_code":'), status, F.lit(',"props":"k'), k, F.lit('"}'),
    )
    return canonical(
        e.select(
            F.col("event_id").alias("ingest_seq"), "ts", F.concat(F.lit("tenant-"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
            F.create_map(F.lit("service"), F.col("event_type"), F.lit("env"), F.when(F.col("user_id") % 2 == 0, "prod").otherwise("dev")).alias("stream_labels"),
            F.create_map(F.lit("host"), F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string"))).alias("resource_attrs"), body.alias("body"),
        )
    )


def driver_events_logfmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events with logfmt bodies."""
    e = _dealt(spark.read.parquet(f"{sf_dir}/events.parquet"))
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING").otherwise("info")
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    body = F.concat(
        F.lit("level="), level, F.lit(" service="), "event_type", F.lit(" user=u"), F.col("user_id").cast("string"), F.lit(" status="), status,
        F.lit(' msg="k'), F.regexp_replace("props", "[^0-9]", ""), F.lit('" ts='), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"),
    )
    labels = F.create_map(F.lit("service"), F.col("event_type"))
    return canonical(e.select(F.col("event_id").alias("ingest_seq"), "ts", F.concat(F.lit("tenant-"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), labels.alias("stream_labels"), body.alias("body")))


def driver_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `documents` table as log events, a minute apart."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ts = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT))")
    return canonical(d.select(F.col("doc_id").alias("ingest_seq"), ts.alias("ts"), F.concat(F.lit("tenant-"), (F.col("doc_id") % 3).cast("string")).alias("tenant_id"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("stream_labels"), F.col("text").alias("body")))


def tenants_table(spark: SparkSession) -> DataFrame:
    """Settings of the driver's tenants; tenant-2 has none."""
    rows = [("tenant-0", 10, False, False), ("tenant-1", 20, True, False)]
    return spark.createDataFrame(rows, "tenant_id string, retention_days int, protected boolean, legal_hold boolean")
