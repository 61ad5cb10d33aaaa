"""Named queries over the driver's tables and the SQL that gives the same rows.

Outputs are scalars: labels and lists are shown as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunks, lifecycle, placement, quota, search, selector, stages, telemetry, tenants
from ..sources import payloads, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'info' END"
_CODE = "CASE WHEN event_type = 'error' THEN '500' ELSE '200' END"
_K = "regexp_replace(props, '[^0-9]', '', 'g')"
#: The event table in SQL.
_E = f"""e AS (SELECT event_id AS ingest_seq, ts, user_id, event_type AS service, 'tenant-' || (user_id % 3) AS tenant_id,
  CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'dev' END AS env, 'h' || (user_id % 10) AS host, {_LEVEL} AS level, {_CODE} AS code, {_K} AS k, value,
  '{{"service":"' || event_type || '","level":"' || {_LEVEL} || '","user":"u' || user_id || '","status_code":' || {_CODE} || ',"props":"k' || {_K} || '"}}' AS body,
  'tenant-' || (user_id % 3) || '|env=' || (CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'dev' END) || '|service=' || event_type AS stream_key
  FROM events)"""
_START, _END = "2024-01-05 00:00:00", "2024-01-20 00:00:00"


def _ns(time: str) -> int:
    from datetime import UTC, datetime

    return int(datetime.fromisoformat(time).replace(tzinfo=UTC).timestamp()) * 1_000_000_000


def register(sql: str | None = None) -> Callable:
    def of(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {_E} {sql}"
        return f

    return of


def _q(**more) -> search.Query:
    return search.Query("tenant-1", _ns(_START), _ns(_END), **more)


_RANGE = f"tenant_id = 'tenant-1' AND ts BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{_END}'"
_OUT = ("ingest_seq", "ts", "tenant_id", "body")


@register(f"SELECT ingest_seq, ts, tenant_id, body FROM e WHERE {_RANGE} AND env = 'prod' AND contains(lower(body), 'error') ORDER BY ts, ingest_seq LIMIT 100")
def search_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenant, time, label and substring, the first hundred."""
    return search.search(tables.driver_events(spark, sf_dir), _q(labels={"env": "prod"}, contains="ERROR", limit=100)).select(*_OUT)


@register(f"SELECT ingest_seq, ts, tenant_id, body FROM e WHERE {_RANGE} AND host = 'h7' AND code = '500'")
def search_field_any_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field predicates find parsed fields and resource attributes alike."""
    parsed = stages.run_stages(tables.driver_events(spark, sf_dir), [stages.Stage("json", "json")])
    return search.search(parsed, _q(fields={"host": "h7", "status_code": "500"})).select(*_OUT)


@register(f"SELECT ingest_seq, ts, tenant_id, body FROM e WHERE {_RANGE} AND regexp_matches(body, '\"user\":\"u1[0-9]\".*:\"k[5-9]\"}}$')")
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(tables.driver_events(spark, sf_dir), _q(regex='"user":"u1[0-9]".*:"k[5-9]"}$')).select(*_OUT)


@register(f"SELECT ingest_seq, ts, tenant_id, body FROM e WHERE {_RANGE} ORDER BY ts, ingest_seq LIMIT 50 OFFSET 50")
def search_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(tables.driver_events(spark, sf_dir), _q(limit=50, cursor="50")).select(*_OUT)


@register("SELECT ingest_seq, ts, tenant_id, body FROM e WHERE tenant_id = 'tenant-0' AND ts BETWEEN TIMESTAMP '2024-01-14 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts DESC, ingest_seq DESC LIMIT 100")
def tail_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = search.tail("tenant-0", _ns("2024-01-15 00:00:00"), _ns("2024-01-14 00:00:00"))
    return search.search(tables.driver_events(spark, sf_dir), q).select(*_OUT)


@register(f"SELECT ingest_seq, ts, tenant_id, body FROM e WHERE {_RANGE} AND service = 'purchase' AND contains(lower(body), 'k42') ORDER BY ts, ingest_seq LIMIT 100")
def loki_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selector with a line filter and times as texts."""
    asked = {"query": '{service="purchase"} |= "k42"', "start": "2024-01-05T00:00:00Z", "end": str(_ns(_END)), "limit": "100"}
    return search.search(tables.driver_events(spark, sf_dir), selector.request(asked, True, "tenant-1")).select(*_OUT)


@register(f"SELECT ingest_seq, ts, tenant_id, body FROM e WHERE {_RANGE} AND regexp_matches(body, '(?i)\"SERVICE\":\"[[:alpha:]]+\",\"level\":\"(?:warn|ERR)[^[:digit:]&&]+\"')")
def search_regex_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of any case, named classes, and characters that mean more to Java than to RE2."""
    pattern = r'''(?i)"SERVICE":"[[:alpha:]]+","level":"(?:warn|ERR)[^[:digit:]&&]+"'''
    return search.search(tables.driver_events(spark, sf_dir), _q(regex=pattern)).select(*_OUT)


@register(f"SELECT ingest_seq, ts, tenant_id, body FROM e WHERE {_RANGE} AND strftime(ts, '%Y-%m-%d/%H') = '2024-01-10/13'")
def search_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hour's segment."""
    return search.search(tables.driver_events(spark, sf_dir), _q(bucket="2024-01-10/13")).select(*_OUT)


@register(f"SELECT count(*) AS matched, CASE WHEN count(*) > 100 THEN '100' ELSE '' END AS next_cursor FROM e WHERE {_RANGE} AND env = 'prod'")
def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page_summary(tables.driver_events(spark, sf_dir), _q(labels={"env": "prod"}, limit=50, cursor="50"))


_written: dict[tuple[str, str, str], str] = {}


def stored_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The events, their chunks' tokens or their chunks' summaries as a stored table, each written once for each
    application and only if it is asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = tables.work_folder(spark, name) + "/t"
        if name == "events":
            tables.write_events(tables.driver_events(spark, sf_dir), path, "overwrite")
        elif name == "tokens":
            tables.write_tokens(chunks.segment_tokens(tables.driver_events(spark, sf_dir)), path, "overwrite")
        else:
            tables.write_summaries(chunks.segment_summaries(tables.driver_events(spark, sf_dir), stored_table(spark, sf_dir, "tokens")), path, "overwrite")
        _written[key] = path
    return tables.read_events(spark, _written[key])


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored events and their chunks' summaries."""
    return stored_table(spark, sf_dir, "events"), stored_table(spark, sf_dir, "summaries")


_HOST = f"{_RANGE} AND env = 'prod' AND host = 'h4' AND contains(lower(body), '\"error\",\"level\"')"


@register(f"SELECT ingest_seq, ts, tenant_id, body FROM e WHERE {_RANGE} AND env = 'prod' AND contains(lower(body), 'error') ORDER BY ts, ingest_seq LIMIT 100")
def search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship search over a stored table: days, row groups by tenant and time."""
    return search.search(stored_table(spark, sf_dir, "events"), _q(labels={"env": "prod"}, contains="ERROR", limit=100)).select(*_OUT)


@register(f"SELECT ingest_seq, ts, tenant_id, body FROM e WHERE {_HOST}")
def search_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only events of chunks whose summaries may hold labels, field and tokens."""
    events, summaries, tokens = (stored_table(spark, sf_dir, name) for name in ("events", "summaries", "tokens"))
    return search.pruned_search(events, summaries, _q(labels={"env": "prod"}, fields={"host": "h4"}, contains='"error","level"'), tokens).select(*_OUT)


@register(f"SELECT count(*) AS candidate_chunks, count(DISTINCT stream_key) AS candidate_streams, CAST(coalesce(sum(n), 0) AS BIGINT) AS candidate_events, count(*) * 3 AS cost FROM (SELECT stream_key, count(*) AS n FROM e WHERE tenant_id = 'tenant-1' AND env = 'prod' GROUP BY stream_key, date_trunc('hour', ts) HAVING min(ts) <= TIMESTAMP '{_END}' AND max(ts) >= TIMESTAMP '{_START}' AND bool_or(service = 'error'))")
def explain_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the summaries and their tokens leave of a search. The token `error` is in the bodies of error events' streams alone."""
    q = _q(labels={"env": "prod"}, fields={"host": "h4"}, contains='"error","level"')
    return search.explain(stored_table(spark, sf_dir, "summaries"), q, stored_table(spark, sf_dir, "tokens"))


@register("SELECT ingest_seq, ts, tenant_id, body, 0 AS tier FROM e")
def hot_cold_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the stored events comes again as new ones."""
    stored = tables.driver_events(spark, sf_dir)
    new = stored.where("ingest_seq % 10 = 0").withColumn("tier", F.lit(1).cast("byte"))
    return search.merged(stored, new).select(*_OUT, F.col("tier").cast("int").alias("tier"))


@register(f"SELECT count(*) AS candidate_rows, count(DISTINCT stream_key) AS candidate_streams FROM e WHERE {_RANGE} AND env = 'prod'")
def candidate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.candidate_stats(tables.driver_events(spark, sf_dir), _q(labels={"env": "prod"}, contains="error"))


@register("SELECT stream_key, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM e GROUP BY stream_key")
def stream_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.driver_events(spark, sf_dir).withColumn("stream_key", text.stream_key("tenant_id", "stream_labels"))
    return e.groupBy("stream_key").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@register("SELECT 'service' AS key, service AS value, count(*) AS events FROM e GROUP BY service UNION ALL SELECT 'env', env, count(*) FROM e GROUP BY env")
def label_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(tables.driver_events(spark, sf_dir))


@register("SELECT key, value, count(*) AS events FROM (SELECT unnest(['service', 'level', 'user', 'status_code', 'props']) AS key, unnest([service, level, 'u' || user_id, code, 'k' || k]) AS value FROM e) GROUP BY key, value")
def field_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = stages.run_stages(tables.driver_events(spark, sf_dir), [stages.Stage("json", "json")])
    return search.postings(parsed, "parsed_fields")


@register("SELECT ingest_seq FROM e WHERE service = 'click' INTERSECT SELECT ingest_seq FROM e WHERE env = 'dev'")
def postings_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.intersect_postings(tables.driver_events(spark, sf_dir), {"service": "click", "env": "dev"})


def _fields(df: DataFrame, *names: str) -> DataFrame:
    return df.select("ingest_seq", *[text.get("parsed_fields", n).alias(n) for n in names])


@register("SELECT ingest_seq, service, level, 'u' || user_id AS \"user\", code AS status_code, 'k' || k AS props FROM e")
def pipeline_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = stages.run_stages(tables.driver_events(spark, sf_dir), [stages.Stage("json", "json")])
    return _fields(done.where("failed IS NULL"), "service", "level", "user", "status_code", "props")


@register("SELECT ingest_seq, level, service, 'u' || user_id AS \"user\", code AS status, 'k' || k AS msg FROM e")
def pipeline_logfmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = stages.run_stages(tables.driver_events_logfmt(spark, sf_dir), [stages.Stage("logfmt", "logfmt")])
    return _fields(done, "level", "service", "user", "status", "msg")


@register("SELECT ingest_seq, code AS status, CAST(user_id AS VARCHAR) AS user_no FROM e")
def pipeline_regex_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = r"user=u(?P<user_no>\d+) status=(?P<status>\d+)"
    done = stages.run_stages(tables.driver_events_logfmt(spark, sf_dir), [stages.Stage("regex", "regex", {"pattern": pattern})])
    return _fields(done, "status", "user_no")


@register("SELECT ingest_seq, 'eu' AS region, code AS http_status, '' AS status, '[REDACTED]' AS \"user\", replace('level=' || level || ' service=' || service, 'service', '***') AS head FROM e")
def pipeline_static_rename_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = stages.run_stages(
        tables.driver_events_logfmt(spark, sf_dir),
        [
            stages.Stage("logfmt", "logfmt"), stages.Stage("static", "static", {"label.region": "eu", "origin": "driver"}),
            stages.Stage("rename", "rename", {"from": "status", "to": "http_status"}), stages.Stage("user", "redact", {"field": "user"}),
            stages.Stage("word", "redact", {"field": "service", "target": "body", "replacement": "***"}),
        ],
    )
    head = F.regexp_extract("body", r"^(level=\S+ \S+=\S+)", 1)
    return _fields(done.withColumn("parsed_fields", text.overlay(F.col("parsed_fields"), F.create_map(F.lit("region"), text.get("stream_labels", "region"), F.lit("head"), head))), "region", "http_status", "status", "user", "head")


@register("SELECT ingest_seq, date_trunc('second', ts) AS ts, CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000000000 AS ts_ns FROM e")
def pipeline_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = stages.run_stages(tables.driver_events_logfmt(spark, sf_dir), [stages.Stage("logfmt", "logfmt"), stages.Stage("time", "timestamp", {"source": "ts", "format": "unix"})])
    return done.select("ingest_seq", "ts", "ts_ns")


@register("SELECT ingest_seq, CASE lower(level) WHEN 'warning' THEN 'warn' ELSE lower(level) END AS severity FROM e")
def pipeline_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = stages.run_stages(tables.driver_events(spark, sf_dir), [stages.Stage("json", "json"), stages.Stage("severity", "severity", {"source": "level"})])
    return done.select("ingest_seq", "severity")


@register("SELECT ingest_seq, service FROM e WHERE service <> 'view' AND NOT contains('u' || user_id, '7')")
def pipeline_filter_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [
        stages.Stage("json", "json"), stages.Stage("views", "filter", {"field": "service", "value": "view"}),
        stages.Stage("sevens", "drop", {"field": "user", "op": "contains", "value": "7"}),
    ]
    done = stages.run_stages(tables.driver_events(spark, sf_dir), steps)
    return done.where("NOT dropped").select("ingest_seq", text.get("parsed_fields", "service").alias("service"))


@register("SELECT 'json' AS stage, count(*) AS errors FROM e UNION ALL SELECT 'clicks', count(*) FROM e WHERE service = 'click'")
def pipeline_stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """logfmt bodies are no JSON; that error is ignored, and clicks are dropped."""
    steps = [stages.Stage("json", "json", {"ignore_error": "true"}), stages.Stage("clicks", "filter", {"field": "service", "value": "click"})]
    return stages.stage_stats(stages.run_stages(tables.driver_events_logfmt(spark, sf_dir), steps))


_PROMOTED = "'env=' || env || '|host=' || host || '|service=' || service || '|severity=' || CASE lower(level) WHEN 'warning' THEN 'warn' ELSE lower(level) END || '|status_code=' || code"


def _shown(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(k, F.lit("="), F.element_at(m, k))), "|")


def _default(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = stages.run_stages(tables.driver_events(spark, sf_dir), tenants.default_pipeline())
    return stages.promote(done, ["service", "env", "severity"], ["status_code", "user"], ["user"])


@register(f"SELECT ingest_seq, {_PROMOTED.replace(chr(39) + '|host=' + chr(39) + ' || host || ', '')} AS labels FROM e")
def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _default(spark, sf_dir).select("ingest_seq", _shown(F.col("stream_labels")).alias("labels"))


@register("SELECT stream_key, severity, count(*) AS events FROM (SELECT 'tenant-' || (user_id % 3) || '|env=' || env || '|service=' || service || '|severity=' || (CASE lower(level) WHEN 'warning' THEN 'warn' ELSE lower(level) END) || '|status_code=' || code AS stream_key, CASE lower(level) WHEN 'warning' THEN 'warn' ELSE lower(level) END AS severity FROM e) GROUP BY 1, 2")
def default_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _default(spark, sf_dir).withColumn("stream_key", text.stream_key("tenant_id", "stream_labels"))
    return done.where("failed IS NULL AND NOT dropped").groupBy("stream_key", "severity").agg(F.count("*").alias("events"))


@register("SELECT doc_id AS ingest_seq, CASE WHEN strlen(text) > 4096 THEN 'body_bytes' ELSE 'none' END AS broken FROM documents")
def limits_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.coalesce(stages.violation(max_body=4096), F.lit("none"))
    return tables.driver_documents(spark, sf_dir).select("ingest_seq", broken.alias("broken"))


@register("SELECT doc_id AS ingest_seq FROM documents WHERE strlen(text) + 8 + 10 + strlen(lang) + strlen(source) > 4096 + 256")
def admission_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenant (8 bytes), the label names (10) and values and the body against the body limit and 128 bytes a label."""
    return tables.driver_documents(spark, sf_dir).where(lifecycle.over_budget(4096)).select("ingest_seq")


@register("SELECT ingest_seq, e.tenant_id, coalesce(t.days, -1) AS retention_days FROM e LEFT JOIN (VALUES ('tenant-0', 10), ('tenant-1', 20)) t(tenant_id, days) ON e.tenant_id = t.tenant_id")
def tenant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lifecycle.with_tenant(tables.driver_events(spark, sf_dir), tables.tenants_table(spark))
    return rows.select("ingest_seq", "tenant_id", F.coalesce("retention_days", F.lit(-1)).alias("retention_days"))


@register("SELECT ingest_seq, CASE tenant_id WHEN 'tenant-0' THEN 'info' WHEN 'tenant-1' THEN CASE lower(level) WHEN 'warning' THEN 'warn' ELSE lower(level) END ELSE '' END AS severity, CASE tenant_id WHEN 'tenant-2' THEN 'unknown_tenant' WHEN 'tenant-0' THEN CASE WHEN strlen(body) > 80 THEN 'body_bytes' ELSE 'none' END ELSE 'none' END AS broken FROM e")
def tenant_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tenant has a pipeline and limits of its own, one the defaults, one isn't known."""
    own = {"own": [stages.Stage("json", "json"), stages.Stage("severity", "severity", {"value": "INFO"})]}
    known = [tenants.Tenant("tenant-0", pipelines=own, active="own", max_body=80), tenants.Tenant("tenant-1")]
    done = tenants.ingested(tables.driver_events(spark, sf_dir), known)
    return done.select("ingest_seq", "severity", F.coalesce("broken", F.lit("none")).alias("broken"))


def _payload(spark: SparkSession, sf_dir: str, payload: Column) -> DataFrame:
    e = tables.driver_events(spark, sf_dir)
    return e.select(F.col("ingest_seq").alias("arrival"), payload.alias("payload"))


def _native(spark: SparkSession, sf_dir: str, time: Column) -> DataFrame:
    one = F.struct(time.alias("timestamp"), "tenant_id", "stream_labels", "body", F.map_concat("resource_attrs").alias("log_attrs"))
    two = F.struct(F.lit(None).cast("string").alias("timestamp"), "tenant_id", "stream_labels", F.lit("second").alias("body"), F.lit(None).cast("map<string,string>").alias("log_attrs"))
    return _payload(spark, sf_dir, F.to_json(F.struct(F.array(one, two).alias("events"))))


@register("SELECT ingest_seq * 1048576 AS ingest_seq, CAST(epoch_us(ts) AS BIGINT) * 1000 AS ts_ns, tenant_id, body, env, host FROM e UNION ALL SELECT ingest_seq * 1048576 + 1, 7, tenant_id, 'second', env, '' FROM e")
def native_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events a payload; the second has no time and gets the given one."""
    rows = payloads.read_native(_native(spark, sf_dir, _rfc3339()), F.lit(7))
    return rows.select("ingest_seq", "ts_ns", "tenant_id", "body", text.get("stream_labels", "env").alias("env"), text.get("log_attrs", "host").alias("host"))


def _rfc3339() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


@register("SELECT ingest_seq AS arrival, CASE ingest_seq % 3 WHEN 1 THEN 'time' ELSE 'json' END AS reason FROM e WHERE ingest_seq % 3 > 0")
def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three payloads one is good, one has a time that can't be read, and one is cut off."""
    good = _native(spark, sf_dir, F.when(F.col("ingest_seq") % 3 == 1, "yesterday").otherwise(_rfc3339()))
    cut = F.when(F.col("arrival") % 3 == 2, F.substring("payload", 1, 40)).otherwise(F.col("payload"))
    return payloads.rejects(good.withColumn("payload", cut), "native").select("arrival", "reason")


@register("SELECT CAST(epoch_us(ts) AS BIGINT) * 1000 AS ts_ns, tenant_id, body, host AS resource_host, service AS attr_service, level AS severity FROM e")
def otlp_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an OTLP request, read back."""
    def attr(k: str, v: Column) -> Column:
        return F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))

    m = F.col("stream_labels")
    level = F.regexp_extract("body", '"level":"([A-Za-z]+)"', 1)
    record = F.struct(
        F.col("ts_ns").cast("string").alias("timeUnixNano"), level.alias("severityText"), F.struct(F.col("body").alias("stringValue")).alias("body"),
        F.array(attr("service", F.lit("first")), attr("service", m["service"])).alias("attributes"),
    )
    resource = F.struct(F.array(attr("tenant_id", F.col("tenant_id")), attr("host", F.col("resource_attrs")["host"])).alias("attributes"))
    request = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    rows = payloads.read_otlp(_payload(spark, sf_dir, F.to_json(request)))
    return rows.select("ts_ns", "tenant_id", "body", text.get("resource_attrs", "host").alias("resource_host"), text.get("log_attrs", "service").alias("attr_service"), "severity")


@register("SELECT CAST(epoch_us(ts) AS BIGINT) * 1000 AS ts_ns, 'acme' AS tenant_id, body, env, 'm' || host AS metadata FROM e")
def loki_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a push with a short entry, which is left out, read back."""
    entry = F.array(F.col("ts_ns").cast("string"), F.col("body"), F.concat(F.lit("m"), F.col("resource_attrs")["host"]))
    request = F.struct(F.array(F.struct(F.col("stream_labels").alias("stream"), F.array(entry, F.array(F.lit("1"))).alias("values"))).alias("streams"))
    rows = payloads.read_loki(_payload(spark, sf_dir, F.to_json(request)), "acme")
    return rows.select("ts_ns", "tenant_id", "body", text.get("stream_labels", "env").alias("env"), text.get("log_attrs", "metadata").alias("metadata"))


@register("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d/%H') AS bucket, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM e GROUP BY 1")
def segment_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.driver_events(spark, sf_dir).withColumn("bucket", text.bucket(F.col("ts")))
    return e.groupBy("bucket").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@register("SELECT stream_key, chunk, count(*) AS event_count, CAST(sum(strlen(body) + strlen(tenant_id) + 10 + strlen(env) + strlen(service)) AS BIGINT) AS bytes, min(epoch_us(ts)) * 1000 AS min_ts_ns, max(epoch_us(ts)) * 1000 AS max_ts_ns FROM (SELECT *, (row_number() OVER (PARTITION BY stream_key ORDER BY ts, ingest_seq) - 1) // 100 AS chunk FROM e) GROUP BY 1, 2")
def chunk_summary_count_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label names are 7 and 3 bytes."""
    e = chunks.numbered(tables.driver_events(spark, sf_dir)).withColumn("chunk", F.floor(F.col("at") / 100))
    return chunks.summaries(e, "stream_key", "chunk").select("stream_key", "chunk", "event_count", "bytes", "min_ts_ns", "max_ts_ns")


@register()
def chunk_builder_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = chunks.build_chunks(tables.driver_events(spark, sf_dir), 50, 4096, 600_000_000_000)
    return built.groupBy("stream_key", "chunk").agg(F.count("*").alias("event_count"))


@register("SELECT stream_key, count(DISTINCT token) AS tokens FROM (SELECT stream_key, unnest(regexp_split_to_array(lower(body), '[^a-z0-9]+')) AS token FROM e) WHERE token <> '' GROUP BY 1")
def tokens_per_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.driver_events(spark, sf_dir)
    rows = e.select(text.stream_key("tenant_id", "stream_labels").alias("stream_key"), F.explode(F.array_distinct(text.tokens(F.col("body")))).alias("token"))
    return rows.groupBy("stream_key").agg(F.countDistinct("token").alias("tokens"))


_TOKENS = """, c AS (SELECT stream_key, body, (row_number() OVER (PARTITION BY stream_key ORDER BY ts, ingest_seq) - 1) // 20 AS chunk FROM e),
  t AS (SELECT DISTINCT stream_key, chunk, token FROM (SELECT stream_key, chunk, unnest(regexp_split_to_array(lower(body), '[^a-z0-9]+')) AS token FROM c) WHERE token <> ''),
  h AS (SELECT token, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(token, ''), lambda x: ascii(x)::HUGEINT)),
    lambda a, b: (xor(a::UBIGINT, b::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616) AS h FROM (SELECT DISTINCT token FROM t UNION SELECT unnest(['k42', 'error']))),
  b AS (SELECT token, [(h // (65536::HUGEINT ** k)::HUGEINT) % 64 + 64 * k FOR k IN [0, 1, 2, 3]] AS bits FROM h),
  m AS (SELECT stream_key, chunk, list(DISTINCT bit) AS have, max(has) AS has FROM (SELECT stream_key, chunk, unnest(bits) AS bit, token = 'k42' AS has FROM t JOIN b USING (token)) GROUP BY 1, 2)
  SELECT stream_key, chunk, (SELECT bool_and(list_has_all(have, bits)) FROM b WHERE token IN ('k42', 'error')) AS may, has AS has_k42 FROM m"""


@register(_TOKENS)
def bloom_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = chunks.numbered(tables.driver_events(spark, sf_dir)).withColumn("chunk", F.floor(F.col("at") / 20))
    s = chunks.summaries(e, "stream_key", "chunk")
    return s.select("stream_key", "chunk", chunks.may_contain("k42 error").alias("may"), F.array_contains("tokens", "k42").alias("has_k42"))


@register(f"SELECT count(*) AS candidate_chunks, count(DISTINCT stream_key) AS candidate_streams, count(*) * 3 AS cost FROM (SELECT stream_key, strftime(ts, '%Y-%m-%d/%H') FROM e WHERE {_RANGE} AND env = 'prod' GROUP BY 1, 2)")
def explain_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that a query touches, times one and its label and field conditions."""
    q = _q(labels={"env": "prod"}, fields={"status_code": "500"})
    e = tables.driver_events(spark, sf_dir).where(search.matches(_q(labels=q.labels)))
    hit = e.select(text.stream_key("tenant_id", "stream_labels").alias("stream_key"), text.bucket(F.col("ts")).alias("bucket")).distinct()
    return hit.agg(F.count("*").alias("candidate_chunks"), F.countDistinct("stream_key").alias("candidate_streams"), (F.count("*") * (1 + len(q.labels) + len(q.fields))).alias("cost"))


@register()  # CRC-32 isn't in SQL
def queue_partition_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lifecycle.enqueue(tables.driver_events(spark, sf_dir), "logs.normalized.v1")
    commits = m.groupBy("topic", "partition").agg(F.floor(F.max("offset") * 0.75).alias("committed"))
    return lifecycle.lag(m, commits)


@register("SELECT topic, CAST(sum(high) AS BIGINT) AS high, CAST(sum(greatest(0, high - committed)) AS BIGINT) AS lag FROM (SELECT 'logs.' || service AS topic, env AS partition, count(*) AS high, count(*) - count(*) // 4 AS committed FROM e GROUP BY 1, 2) GROUP BY topic")
def queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.driver_events(spark, sf_dir).select(F.concat(F.lit("logs."), text.get("stream_labels", "service")).alias("topic"), text.get("stream_labels", "env").alias("partition"), "ingest_seq")
    n = e.groupBy("topic", "partition").agg(F.count("*").alias("n"))
    m, commits = n.select("topic", "partition", (F.col("n") - 1).alias("offset")), n.select("topic", "partition", (F.col("n") - F.floor(F.col("n") / 4)).alias("committed"))
    return lifecycle.lag(m, commits).groupBy("topic").agg(F.sum("high").alias("high"), F.sum("lag").alias("lag"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition for each kind of event, offsets in order of arrival."""
    e = tables.driver_events(spark, sf_dir)
    m = e.select(F.lit("logs").alias("topic"), text.get("stream_labels", "service").alias("partition"), "ingest_seq", F.floor(F.col("ingest_seq") / 1000).alias("part"))
    sums = m.groupBy("partition", "part").agg(F.count("*").alias("n")).withColumn("lower", F.expr("coalesce(sum(n) OVER (PARTITION BY partition ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    return m.join(sums, ["partition", "part"]).select("topic", "partition", "ingest_seq", (F.expr("row_number() OVER (PARTITION BY partition, part ORDER BY ingest_seq)") - 1 + F.col("lower")).cast("long").alias("offset"))


_MESSAGES = "SELECT 'logs' AS topic, service AS partition, ingest_seq, row_number() OVER (PARTITION BY service ORDER BY ingest_seq) - 1 AS \"offset\" FROM e"


@register(f"SELECT * FROM ({_MESSAGES}) WHERE \"offset\" >= CASE partition WHEN 'view' THEN 10 WHEN 'click' THEN 20 ELSE 0 END ORDER BY ingest_seq LIMIT 100")
def queue_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = spark.createDataFrame([("logs", "view", 10), ("logs", "click", 5), ("logs", "click", 20)], "topic string, partition string, committed long")
    return lifecycle.poll(_messages(spark, sf_dir), commits)


@register(f"SELECT * FROM ({_MESSAGES}) ORDER BY ingest_seq LIMIT 250")
def queue_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.replay(_messages(spark, sf_dir), 250)


@register("SELECT 'logs' AS topic, service AS partition, count(*) AS committed FROM e GROUP BY service UNION ALL SELECT 'logs', 'other', 3")
def queue_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = spark.createDataFrame([("logs", "view", 10), ("logs", "other", 3)], "topic string, partition string, committed long")
    return lifecycle.committed(_messages(spark, sf_dir), commits)


@register()
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a few MiB against limits of 1 and 2 MiB a second."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    r = e.select(F.col("event_id").alias("request_id"), F.concat(F.lit("tenant-"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 10).alias("at_ns"), (F.col("value") * 10000).cast("long").alias("bytes"), (F.col("user_id") % 3).cast("int").alias("limit_mb"))
    return quota.admit(r)


@register("SELECT \"to\", attempts, count(*) AS messages FROM (SELECT CASE WHEN service <> 'error' THEN 'done' WHEN user_id % 4 + 1 >= 3 THEN 'dead' ELSE 'retry' END AS \"to\", CASE WHEN service <> 'error' THEN user_id % 4 ELSE user_id % 4 + 1 END AS attempts FROM e) GROUP BY 1, 2")
def retry_dlq_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.driver_events(spark, sf_dir)
    user = F.regexp_extract("body", '"user":"u([0-9]+)"', 1).cast("long")
    m = e.select((text.get("stream_labels", "service") != "error").alias("ok"), (user % 4).alias("attempts"))
    return lifecycle.after_failure(m).groupBy("to", "attempts").agg(F.count("*").alias("messages"))


_MEMBERS = [("a", "ready"), ("b", "ready"), ("c", "ready"), ("d", "draining")]
_PLACED = "SELECT key, member, CASE WHEN r = 1 THEN 'primary' ELSE 'replica' END AS role FROM (SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY sha256(key || '|' || member) DESC, member) AS r FROM (SELECT DISTINCT stream_key AS key FROM e), (VALUES ('a'), ('b'), ('c')) m(member)) WHERE r <= 2"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = tables.driver_events(spark, sf_dir).select(text.stream_key("tenant_id", "stream_labels").alias("key")).distinct()
    return placement.place(keys, _MEMBERS)


@register(_PLACED)
def rendezvous_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.assignments(_placed(spark, sf_dir))


@register(f"SELECT member, count(*) FILTER (role = 'primary') AS primaries, count(*) FILTER (role = 'replica') AS replicas FROM ({_PLACED}) GROUP BY member")
def rebalance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.balance(_placed(spark, sf_dir))


@register(f"SELECT key, member, 'upsert' AS action FROM ({_PLACED}) WHERE role = 'replica' UNION ALL SELECT DISTINCT stream_key, 'gone', 'delete' FROM e")
def placement_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placement.assignments(_placed(spark, sf_dir))
    current = rows.where("role = 'primary'").select("key", "member").unionByName(rows.select("key", F.lit("gone").alias("member")).distinct())
    return placement.reconcile(rows, current)


_SEGMENTS = "SELECT tenant_id, strftime(date_trunc('hour', ts), '%Y-%m-%d/%H') AS bucket, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ends, count(DISTINCT stream_key) AS chunks FROM e GROUP BY 1, 2, 3"


def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.driver_events(spark, sf_dir).withColumns({"stream_key": text.stream_key("tenant_id", "stream_labels"), "bucket": text.bucket(F.col("ts")), "ends": (F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz")})
    segments = e.groupBy("tenant_id", "bucket", "ends").agg(F.countDistinct("stream_key").alias("chunks"))
    return lifecycle.retention(segments, tables.tenants_table(spark), F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'"))


_DECIDED = f"SELECT s.tenant_id, bucket, chunks, s.tenant_id <> 'tenant-1' AND ends < TIMESTAMP '2024-01-31 00:00:00' - CASE s.tenant_id WHEN 'tenant-0' THEN INTERVAL 10 DAY ELSE INTERVAL 7 DAY END AS expired FROM ({_SEGMENTS}) s"


@register(_DECIDED)
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retention(spark, sf_dir).select("tenant_id", "bucket", "chunks", "expired")


@register(f"SELECT tenant_id, count(*) AS scanned, count(*) FILTER (expired) AS deleted_segments, CAST(coalesce(sum(chunks) FILTER (expired), 0) AS BIGINT) AS deleted_chunks FROM ({_DECIDED}) GROUP BY 1")
def retention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.retention_report(_retention(spark, sf_dir))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    error = F.col("event_type") == "error"
    return e.select(F.lit("POST").alias("method"), F.concat(F.lit("/"), "event_type").alias("path"), F.when(error, 500).otherwise(200).alias("status"), (F.col("value") / 100).alias("seconds"), "ts")


@register("SELECT 'POST' AS method, '/' || service AS path, CAST(code AS INTEGER) AS status, count(*) AS requests FROM e GROUP BY 1, 2, 3")
def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.request_counts(_requests(spark, sf_dir))


@register("SELECT '/' || service AS path, le, count(*) FILTER (value / 100 <= b) AS cumulative FROM e, (VALUES ('0.005', 0.005::DOUBLE), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1.0), ('2.0', 2.0), ('5.0', 5.0), ('+Inf', 1e300)) v(le, b) GROUP BY 1, 2")
def http_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.latency_histogram(_requests(spark, sf_dir), "path")


def _p95(key: str) -> str:
    """SQL: the 95th percentile of a histogram for each key, as table q."""
    bounds = ", ".join(f"({i + 1}, {b}::DOUBLE)" for i, b in enumerate((*telemetry.BOUNDS, 1e300)))
    return f""", c AS (SELECT {key} AS key, i, b, count(*) FILTER (value / 100 <= b) AS n FROM e, (VALUES {bounds}) v(i, b) GROUP BY ALL),
  r AS (SELECT key, max(n) * 0.95::DOUBLE AS rank FROM c GROUP BY 1), p AS (SELECT key, rank, min(i) FILTER (n >= rank) AS bin FROM c JOIN r USING (key) GROUP BY ALL),
  q AS (SELECT p.key, CASE WHEN bin > 10 THEN 5.0::DOUBLE ELSE coalesce(lo.b, 0::DOUBLE) + (hi.b - coalesce(lo.b, 0::DOUBLE)) * (rank - coalesce(lo.n, 0)) / (hi.n - coalesce(lo.n, 0)) END AS p95
    FROM p JOIN c hi ON hi.key = p.key AND hi.i = bin LEFT JOIN c lo ON lo.key = p.key AND lo.i = bin - 1)"""


@register(_p95("'/' || service") + " SELECT key AS path, p95 FROM q")
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.array(*[F.count_if(F.col("seconds") <= b) for b in telemetry.BOUNDS], F.count("*"))
    rows = _requests(spark, sf_dir).groupBy("path").agg(counts.alias("n"))
    return rows.select("path", telemetry.histogram_quantile(0.95, F.col("n")).alias("p95"))


@register("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS requests, count(*) FILTER (service = 'error') AS errors, count(*) FILTER (service = 'error') / count(*) AS ratio FROM e GROUP BY 1")
def error_rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.error_ratio(_requests(spark, sf_dir))


@register("SELECT 'http_requests_total{method=\"POST\",path=\"/' || service || '\",status=\"' || code || '\"} ' || count(*) AS line FROM e GROUP BY service, code UNION ALL SELECT 'http_request_duration_seconds_bucket{method=\"POST\",path=\"/' || service || '\",status=\"' || code || '\",le=\"' || le || '\"} ' || count(*) FILTER (value / 100 <= b) FROM e, (VALUES ('0.005', 0.005::DOUBLE), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1.0), ('2.0', 2.0), ('5.0', 5.0), ('+Inf', 1e300)) v(le, b) GROUP BY service, code, le UNION ALL SELECT 'http_request_duration_seconds_sum{method=\"POST\",path=\"/' || service || '\",status=\"' || code || '\"} ' || round(sum(value / 100), 6) FROM e GROUP BY service, code UNION ALL SELECT 'http_request_duration_seconds_count{method=\"POST\",path=\"/' || service || '\",status=\"' || code || '\"} ' || count(*) FROM e GROUP BY service, code")
def prometheus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.exposition(_requests(spark, sf_dir))


_OVER = """, w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) FILTER (service = 'error') / count(*) AS ratio FROM e GROUP BY 1),
  a AS (SELECT window_start, 'errors' AS alert, ratio AS value, ratio > 0.05 AS over FROM w UNION ALL SELECT key, 'latency', p95, p95 > 3 FROM q)
  SELECT a.window_start, a.alert, a.value, a.over AND coalesce(b.over, false) AS firing FROM a LEFT JOIN a b ON b.alert = a.alert AND b.window_start = a.window_start - INTERVAL 5 MINUTE"""


@register(_p95("time_bucket(INTERVAL 5 MINUTE, ts)") + _OVER)
def alerts_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error ratio and latency of five minutes, over their thresholds for ten."""
    return telemetry.held_alerts(_requests(spark, sf_dir))


@register(_p95("1") + """ SELECT 'errors' AS alert, count(*) FILTER (service = 'error') / count(*) AS value, count(*) FILTER (service = 'error') / count(*) > 0.05 AS firing FROM e
  UNION ALL SELECT 'latency', p95, p95 > 3 FROM q UNION ALL SELECT 'lag', max(n) - 5, max(n) - 5 > 1000 FROM (SELECT count(*) AS n FROM e GROUP BY service) UNION ALL SELECT 'compaction', 1200, false""")
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    return telemetry.alerts(_requests(spark, sf_dir), lifecycle.lag(m, m.select("topic", "partition", F.lit(5).alias("committed")).distinct()), 1200)
