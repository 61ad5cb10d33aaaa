import json

import pytest
from pyspark.sql import functions as F

from logspark.operators.stages import Stage
from logspark.operators.tenants import Tenant, ingested
from logspark.plans import catalogue
from logspark.sources import kafka, payloads, tables
from logspark.sources.kafka import MESSAGE
from logspark.streaming.ingest import deduplicated, event_of, ingest, message_stream, parsed, payload_stream


def payload(spark, x):
    return spark.createDataFrame([(8, json.dumps(x) if not isinstance(x, str) else x)], "arrival long, payload string")


def test_native(spark):
    e = {"timestamp": "2026-05-27T10:00:00.5Z", "tenant_id": "a", "body": "x", "stream_labels": {"s": "1"}}
    rows = payloads.read_native(payload(spark, {"events": [e, {"tenant_id": "b", "body": "y"}]}), F.lit(7)).orderBy("ingest_seq").collect()
    assert [(r.tenant_id, r.body) for r in rows] == [("a", "x"), ("b", "y")] and rows[1].ts_ns == 7 and rows[0].ts_ns % 10**9 == 5 * 10**8
    assert rows[0].ingest_seq == 8 << 20
    for bad, reason in [("no json", "json"), ('{"events": [', "json"), ("[1]", "json"), ({"events": [e, {"timestamp": "now"}]}, "time"), ({"events": 3}, "json")]:
        assert payloads.read_native(payload(spark, bad)).count() == 0
        assert [r.reason for r in payloads.rejects(payload(spark, bad), "native").collect()] == [reason]
    assert payloads.rejects(payload(spark, {}), "native").count() == 0


def test_otlp(spark):
    attr = lambda k, **v: {"key": k, "value": v}
    record = {"timeUnixNano": "12", "severityText": "INFO", "body": {"stringValue": "b"}, "attributes": [attr("host", stringValue="n"), attr("host", intValue="3"), attr("f", boolValue=True), attr("d", doubleValue=1.5), attr("z", doubleValue=0.0), attr("w", doubleValue=2.0), attr("u", doubleValue=1e21), attr("t", doubleValue=0.00001), attr("v", doubleValue=12345678.25)], "traceId": "AAECAw==", "spanId": "XYZ"}
    x = {"resourceLogs": [{"resource": {"attributes": [attr("tenant_id", stringValue="acme")]}, "scopeLogs": [{"logRecords": [record, {"observedTimeUnixNano": "5", "body": {"intValue": "9"}}]}]}, {"scopeLogs": [{"logRecords": [{}]}, {}]}, {}]}
    a, b, c = payloads.read_otlp(payload(spark, x), now=F.lit(99)).orderBy("ingest_seq").collect()
    assert (a.ts_ns, a.tenant_id, a.body, a.severity, a.log_attrs, a.trace_id, a.span_id) == (12, "acme", "b", "INFO", {"host": "3", "f": "true", "d": "1.5", "z": "0", "w": "2", "u": "1e+21", "t": "1e-05", "v": "12345678.25"}, "00010203", "xyz")
    assert (b.ts_ns, b.body) == (5, "9") and (c.ts_ns, c.tenant_id, c.body) == (99, "default", "")
    x["resourceLogs"][1]["scopeLogs"][0]["logRecords"][0]["timeUnixNano"] = "abc"
    assert payloads.read_otlp(payload(spark, x)).count() == 0
    assert [r.reason for r in payloads.rejects(payload(spark, x), "otlp").collect()] == ["time"]


def test_loki(spark):
    x = {"streams": [{"stream": {"service": "api"}, "values": [["5", "line"], ["6"], ["7", "more", "m"]]}]}
    a, b = payloads.read_loki(payload(spark, x), "t").orderBy("ingest_seq").collect()
    assert (a.ts_ns, a.body, a.log_attrs, a.stream_labels) == (5, "line", {}, {"service": "api"}) and b.log_attrs == {"metadata": "m"}
    assert [r.reason for r in payloads.rejects(payload(spark, {"streams": [{"values": [["x", "line"]]}]}), "loki").collect()] == ["time"]


def test_event_table_round_trip(spark, tmp_path):
    e = tables.driver_events(spark, "/root/testdata/sf0.001")
    tables.write_events(e, str(tmp_path / "events"))
    back = tables.read_events(spark, str(tmp_path / "events"))
    assert back.count() == e.count() and back.select("body").exceptAll(e.select("body")).count() == 0


def test_stream_is_batch_and_retries(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"topic": "t", "ingest_seq": k, "attempts": k % 3, "ts": "2024-01-01T00:00:00", "tenant_id": "a" if k != 4 else "", "stream_labels": {"s": "x"}, "body": json.dumps({"k": k}) if k % 4 != 3 else "bad", "severity": ""} for k in range(12)]
    (folder / "a.json").write_text("\n".join(map(json.dumps, lines[:6])))
    (folder / "b.json").write_text("\n".join(map(json.dumps, lines[6:])))
    process = lambda e: parsed(e, [Stage("json", "json"), Stage("f", "filter", {"field": "k", "value": "2"})], [], [], [])
    paths = [str(tmp_path / p) for p in ("events", "retry", "dead", "checkpoint")]
    for _ in range(2):  # the second run finds nothing new
        ingest(message_stream(spark, str(folder), 1), event_of, process, *paths).awaitTermination(120)
    good = {r.ingest_seq for r in spark.read.parquet(paths[0]).collect()}
    assert good == {0, 1, 5, 6, 8, 9, 10}
    failed = {p: {(r.ingest_seq, r.attempts, r.last_error) for r in spark.read.json(p).collect()} for p in paths[1:3]}
    assert failed[paths[1]] == {(3, 1, "json"), (4, 2, "tenant"), (7, 2, "json")} and failed[paths[2]] == {(11, 3, "json")}


def test_payloads_to_table_and_dead_letters(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    events = [{"tenant_id": t, "body": b, "stream_labels": {"s": "x"}, "log_attrs": {"a": "1"}, "trace_id": "T", "timestamp": "2024-01-01T00:00:00.000000001Z"} for t, b in [("a", '{"k":1}'), ("a", "bad")]]
    (folder / "a.json").write_text(json.dumps({"events": events}) + "\n" + "{broken")
    process = lambda e: ingested(e, [Tenant("a", pipelines={"p": [Stage("json", "json")]})])
    paths = [str(tmp_path / p) for p in ("events", "retry", "dead", "checkpoint")]
    ingest(payload_stream(spark, str(folder)), payloads.read_native, process, *paths, max_attempts=1).awaitTermination(120)
    good = spark.read.parquet(paths[0]).collect()
    assert [(r.body, r.parsed_fields, r.ts_ns % 1000) for r in good] == [('{"k":1}', {"k": "1"}, 1)]
    dead = event_of(spark.read.schema(MESSAGE).json(paths[2])).collect()
    assert [(r.body, r.log_attrs, r.trace_id, r.ts_ns % 1000, r.attempts) for r in dead] == [("bad", {"a": "1"}, "T", 1, 1)]


def test_kafka_envelopes(spark):
    rows = event_of(spark.createDataFrame([("t", 1, "x", "a", "hello")], "topic string, attempts int, last_error string, tenant_id string, body string").withColumn("ts_ns", F.lit(5)))
    sent = kafka.records(rows.withColumns({"topic": F.lit("t"), "last_error": F.lit("x")}))
    assert sent.first().key == "a"
    back = kafka.envelopes(sent.select("topic", F.col("value").cast("binary").alias("value"))).first()
    assert (back.body, back.ts_ns, back.attempts, back.malformed) == ("hello", 5, 1, None)
    assert kafka.envelopes(spark.createDataFrame([("t", b"{")], "topic string, value binary")).first().malformed == "{"


def test_stream_dedup(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = {"ingest_seq": 1, "ts": "2024-01-01T00:00:00", "tenant_id": "a", "stream_labels": {}, "body": "x", "severity": ""}
    (folder / "a.json").write_text("\n".join(map(json.dumps, [row, {**row, "ingest_seq": 2}, {**row, "body": "y"}])))
    from logspark.schema import canonical

    q = deduplicated(canonical(message_stream(spark, str(folder)))).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.body for r in spark.table("seen").collect()) == ["x", "y"]


@pytest.mark.parametrize("name", ["native_flatten", "rejects", "loki_flatten", "otlp_flatten"])
def test_payloads_are_parsed_once_on_all_cores(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "RepartitionByExpression [event_id" in plan


def test_a_stored_search_writes_no_summaries(spark, tmp_path):
    sf = tmp_path / "sf"
    sf.mkdir()
    (sf / "events.parquet").symlink_to("/root/testdata/sf0.001/events.parquet")
    assert catalogue.QUERIES["search_stored"](spark, str(sf)).count() > 0
    assert [k[2] for k in catalogue._written if k[1] == str(sf)] == ["events"]
