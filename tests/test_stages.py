from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logspark.operators.stages import Stage, promote, rfc3339_ns, run_stages, stage_stats, violation
from logspark.schema import EVENT_SCHEMA, canonical


def event(spark, body, **more):
    row = {"ingest_seq": 1, "ts": datetime(2026, 5, 27, 9), "tenant_id": "default", "body": body, "stream_labels": {}, "parsed_fields": {}, **more}
    schema = "ingest_seq long, ts timestamp_ntz, tenant_id string, body string, stream_labels map<string,string>, parsed_fields map<string,string>"
    extra = "".join(f", {k} {'map<string,string>' if isinstance(v, dict) else 'string'}" for k, v in more.items() if k not in schema)
    return canonical(spark.createDataFrame([row], schema + extra))


def run(spark, body, *stages, **more):
    return run_stages(event(spark, body, **more), list(stages)).first()


JSON = Stage("json", "json")


def test_canonical_fills_in(spark):
    df = canonical(spark.createDataFrame([(5, None)], "ts_ns long, body string"))
    assert df.schema.fieldNames() == EVENT_SCHEMA.fieldNames()
    r = df.first()
    assert (r.body, r.severity, r.stream_labels, r.ts) == ("", "", {}, datetime(1970, 1, 1))


@pytest.mark.parametrize(
    "body, want",
    [
        ('{"service":"api","status_code":500,"ok":true,"none":null,"r":1.50}', {"service": "api", "status_code": "500", "ok": "true", "none": "<nil>", "r": "1.5"}),
        ("{}", {}), ("null", {}), ('{"a":1} x', None), ("[1]", None), ("text", None), ("", None),
    ],
)
def test_json(spark, body, want):
    r = run(spark, body, JSON)
    assert (r.failed is None) == (want is not None)
    assert r.parsed_fields == (want or {})


def test_logfmt(spark):
    r = run(spark, 'level=warn  msg="a b" =x k= k=2 q="z" plain', Stage("l", "logfmt"))
    assert r.parsed_fields == {"level": "warn", "msg": "a", "k": "2", "q": "z"} and r.failed is None


def test_regex(spark):
    r = run(spark, "status=500 host=api-17", Stage("r", "regex", {"pattern": r"status=(?P<status>\d+)( x=(?P<x_y>.))?"}))
    assert r.parsed_fields == {"status": "500", "x_y": ""}
    assert run(spark, "none", Stage("r", "regex", {"pattern": "(?P<a>z)"})).parsed_fields == {}


def test_chain(spark):
    r = run(
        spark, "level=WARNING secret-token status=500 ts=2026-05-27T10:00:00Z", Stage("l", "logfmt"), Stage("s", "static", {"status_code": "500", "label.region": "eu"}),
        Stage("n", "rename", {"from": "status", "to": "http_status"}), Stage("r", "redact", {"field": "secret-token", "target": "body"}),
        Stage("v", "severity", {"source": "level"}), Stage("t", "timestamp", {"source": "ts", "format": "rfc3339"}),
    )
    assert (r.severity, r.parsed_fields["http_status"], r.stream_labels, r.ts) == ("warn", "500", {"region": "eu"}, datetime(2026, 5, 27, 10))
    assert "secret-token" not in r.body and "[REDACTED]" in r.body and "status" not in r.parsed_fields


@pytest.mark.parametrize("x, ns", [("1970-01-01T00:00:01.000000001Z", 1_000_000_001), ("1970-01-01T01:00:00+01:00", 0), ("2026-05-27", None), ("x", None)])
def test_rfc3339(spark, x, ns):
    assert spark.range(1).select(rfc3339_ns(F.lit(x))).first()[0] == ns


@pytest.mark.parametrize("form, value, ns, failed", [("unix", "12.9", 12_000_000_000, None), ("unix_nano", "77", 77, None), ("unix", "x", None, "t"), ("unix_nano", "1.5", None, "t"), ("unix", "", None, None)])
def test_timestamp_forms(spark, form, value, ns, failed):
    r = run(spark, "x", Stage("t", "timestamp", {"source": "at", "format": form}), parsed_fields={"at": value})
    assert r.failed == failed and (ns is None or r.ts_ns == ns)


def test_filter_drops_and_counts(spark):
    e = run_stages(event(spark, '{"status":"ignore"}'), [JSON, Stage("f", "filter", {"field": "status", "value": "ignore"}), Stage("x", "static", {"a": "b"})])
    r = e.first()
    assert r.dropped and r.failed is None and "a" not in r.parsed_fields
    assert [tuple(x) for x in stage_stats(e).collect()] == [("f", 1)]
    assert run(spark, "{}", Stage("f", "filter", {})).failed == "f"
    assert not run(spark, "{}", Stage("f", "filter", {"field": "a", "value": "b", "op": "contains", "action": "keep"})).dropped


def test_errors(spark):
    assert run(spark, "x", JSON, Stage("s", "static", {"a": "b"})).failed == "json"
    r = run(spark, "x", Stage("json", "json", {"ignore_error": "true"}), Stage("s", "static", {"a": "b"}))
    assert r.failed is None and r.errors == ["json"] and r.parsed_fields == {"a": "b"}
    with pytest.raises(ValueError):
        run(spark, "x", Stage("u", "unknown"))


def test_promotion(spark):
    e = run_stages(event(spark, '{"service":"api","status_code":500}', severity="error"), [JSON])
    r = promote(e, ["service", "severity"], ["service", "status_code"], []).first()
    assert r.stream_labels == {"service": "api", "severity": "error", "status_code": "500"}
    r = promote(e, ["service"], ["status_code"], ["status_code"]).first()
    assert r.stream_labels == {"service": "api"}


@pytest.mark.parametrize(
    "more, rule",
    [({}, None), ({"tenant_id": " "}, "tenant"), ({"body": ""}, "body"), ({"stream_labels": {"a": " "}}, "label"), ({"stream_labels": {c: "1" for c in "abcdefghijklm"}}, "label_count"), ({"body": "é" * 51}, "body_bytes"), ({"parsed_fields": {"a": "v" * 11}}, "field_value")],
)
def test_limits(spark, more, rule):
    df = event(spark, **{"body": "x", **more})
    assert df.select(violation(max_body=100, max_value=10)).first()[0] == rule


@pytest.mark.parametrize(
    "kind, config",
    [("regex", {}), ("regex", {"pattern": "(?=a)"}), ("timestamp", {}), ("filter", {"field": "a", "op": "like"}), ("rename", {"from": "a"}), ("rename", {"from": "a", "to": "b", "target": "body"}), ("redact", {}), ("redact", {"field": "a", "target": "label"})],
)
def test_settings_at_fault_are_errors_of_the_stage(spark, kind, config):
    assert run(spark, "x", Stage("s", kind, config)).failed == "s"
    r = run(spark, "x", Stage("s", kind, {**config, "ignore_error": "true"}), Stage("v", "static", {"a": "b"}))
    assert r.failed is None and r.errors == ["s"] and r.parsed_fields == {"a": "b"}


def test_settings_in_any_case(spark):
    r = run(spark, '{"a":"1","t":"12"}', JSON, Stage("r", "rename", {"from": "a", "to": "b", "target": "PARSED"}), Stage("t", "timestamp", {"source": "t", "format": "UNIX"}))
    assert r.parsed_fields == {"b": "1", "t": "12"} and r.ts_ns == 12 * 10**9
    assert run(spark, "x", Stage("t", "timestamp", {"source": "t", "format": "era"}), parsed_fields={"t": "1"}).failed == "t"
    assert run(spark, "x", Stage("t", "timestamp", {"source": "t", "format": "era"})).failed is None


def test_logfmt_of_many_keys(spark):
    body = " ".join(f"k{i % 700}={i}" for i in range(2000))
    assert run(spark, body, Stage("l", "logfmt")).parsed_fields == {f"k{i % 700}": str(i) for i in range(2000)}


def test_json_kinds(spark):
    r = run(spark, '{"i":12345678901234567,"n":-3,"s":"1.50","o":{"a":[1]},"e":1e3,"z":0.0}', JSON)
    assert r.parsed_fields == {"i": "12345678901234568", "n": "-3", "s": "1.50", "o": '{"a":[1]}', "e": "1000", "z": "0"}
