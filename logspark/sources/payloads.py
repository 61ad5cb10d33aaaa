"""Log payloads (native JSON, OTLP JSON, Loki push) as canonical events.

Each reader takes a table with a `payload` column of JSON texts and `arrival` (a number that orders payloads)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.once import held
from ..schema import canonical

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:boolean>"
_ATTR = f"array<struct<key:string,value:{_VALUE}>>"
_OTLP = (
    f"resourceLogs array<struct<resource:struct<attributes:{_ATTR}>,scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,"
    f"observedTimeUnixNano:string,severityText:string,body:{_VALUE},attributes:{_ATTR},traceId:string,spanId:string>>>>>>"
)
_LOKI = "streams array<struct<stream:map<string,string>,values:array<array<string>>>>"
_NATIVE = (
    "events array<struct<timestamp:string,tenant_id:string,stream_labels:map<string,string>,body:string,severity:string,"
    "resource_attrs:map<string,string>,log_attrs:map<string,string>,parsed_fields:map<string,string>,trace_id:string,span_id:string>>"
)
#: Entries of a payload, so that a number below 2^63 orders all entries of 2^43 payloads.
_ENTRIES = 1 << 20


def any_value(v: Column) -> Column:
    """The first of text, whole number, double and true; else empty. A double that is there counts, even 0."""
    double = v["doubleValue"]
    number = double.try_cast("double")
    return F.coalesce(
        F.when(v["stringValue"] != "", v["stringValue"]), F.when(v["intValue"] != "", v["intValue"]),
        F.when(number.isNull(), double).otherwise(text.general_number(number)), F.when(v["boolValue"], F.lit("true")), F.lit(""),
    )


def _with_attributes(df: DataFrame, name: str, attributes: str) -> DataFrame:
    """df with a map made of an attribute list; the last of a key wins."""
    pairs = F.transform(F.coalesce(F.col(attributes), F.array().cast(_ATTR)), lambda e: F.struct(F.coalesce(e["key"], F.lit("")).alias("k"), any_value(e["value"]).alias("v")))
    return df.withColumn("__pairs", text.sorted_pairs(pairs)).withColumn(name, text.map_of_sorted("__pairs")).drop("__pairs")


def _nanos(x: Column) -> Column:
    """A whole number of nanoseconds, or null."""
    return F.when(x.rlike(r"^[+-]?\d+\z"), x.try_cast("long"))


def _entries(list_: Column, of: Column, element: str) -> Column:
    """flatten() that takes null lists as empty."""
    return F.coalesce(F.flatten(F.transform(list_, lambda x: F.coalesce(of(x), F.array().cast(element)))), F.array().cast(element))


def _opened(payloads: DataFrame, schema: str) -> DataFrame:
    """payloads with `p`, the parsed payload, and `unread`, whether it is no JSON object of that form. A payload is
    made and parsed once, whatever is asked of it later."""
    parsed = F.from_json("payload", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    object_ = F.coalesce(F.col("payload").rlike(r"^\s*\{"), F.lit(False))
    rows = held(held(payloads.select("arrival", F.col("payload").alias("given")), "payload", F.col("given")).drop("given"), "p", F.when(object_, parsed))
    return rows.withColumn("unread", F.col("p").isNull() | F.col("p.__bad").isNotNull())


def _judged(rows: DataFrame, untimed: Column) -> DataFrame:
    """Adds `reason`: why a payload is refused as a whole, or null. `entries` is there by then."""
    reason = F.when(F.col("unread"), "json").when(F.size("entries") >= _ENTRIES, "too_many").when(untimed, "time")
    return held(rows, "reason", reason)


def _native(payloads: DataFrame) -> DataFrame:
    from ..operators.stages import rfc3339_ns

    timed = F.transform("p.events", lambda e: F.struct(e.alias("e"), rfc3339_ns(e["timestamp"]).alias("ns")))
    rows = held(_opened(payloads, _NATIVE), "timed", timed)
    rows = rows.withColumn("entries", F.coalesce("timed", F.array()))
    return _judged(rows, F.exists("entries", lambda x: x["e"]["timestamp"].isNotNull() & x["ns"].isNull()))


def _otlp_time(e: Column) -> Column:
    """The record's own time or else the observed one, as text; blank if there is neither."""
    return text.first_non_blank(e["timeUnixNano"], e["observedTimeUnixNano"])


def _otlp(payloads: DataFrame) -> DataFrame:
    rows = _opened(payloads, _OTLP)
    record = _OTLP[_OTLP.index("logRecords:array<") + len("logRecords:array<") : -len(">>>>>")]
    element = f"struct<attributes:{_ATTR},e:{record}>"

    def records(r: Column) -> Column:
        of_scopes = _entries(r["scopeLogs"], lambda s: s["logRecords"], f"array<{record}>")
        return F.transform(of_scopes, lambda e: F.struct(r["resource"]["attributes"].alias("attributes"), e.alias("e")))

    rows = held(rows, "entries", _entries(F.col("p.resourceLogs"), records, f"array<{element}>"))
    return _judged(rows, F.exists("entries", lambda x: (_otlp_time(x["e"]) != "") & _nanos(_otlp_time(x["e"])).isNull()))


def _loki(payloads: DataFrame) -> DataFrame:
    entry = "struct<stream:map<string,string>,v:array<string>>"
    labelled = lambda s: F.transform(s["values"], lambda v: F.struct(s["stream"].alias("stream"), v.alias("v")))
    rows = held(_opened(payloads, _LOKI), "all", _entries(F.col("p.streams"), labelled, f"array<{entry}>"))
    rows = held(rows, "entries", F.filter("all", lambda x: F.coalesce(F.size(x["v"]) >= 2, F.lit(False))))
    return _judged(rows, F.exists("entries", lambda x: _nanos(F.get(x["v"], F.lit(0))).isNull()))


def _accepted(judged: DataFrame) -> DataFrame:
    """ingest_seq (payloads in order of arrival, entries in order in each) and `x`, the entry."""
    rows = judged.where("reason IS NULL").select("arrival", F.posexplode("entries").alias("at", "x"))
    return rows.select((F.col("arrival") * _ENTRIES + F.col("at")).alias("ingest_seq"), "x")


def rejects(payloads: DataFrame, form: str) -> DataFrame:
    """arrival, reason, payload of what is refused: `json` (not of the form native, otlp or loki), `time` (an entry's
    time can't be read) or `too_many` entries. One bad entry refuses its payload. Keys that the form doesn't know are
    passed over."""
    return {"native": _native, "otlp": _otlp, "loki": _loki}[form](payloads).where("reason IS NOT NULL").select("arrival", "reason", "payload")


def read_native(payloads: DataFrame, now: Column | None = None) -> DataFrame:
    """{"events": [...]}; an event without a time has the time of reading. Refused payloads are left out."""
    now = F.unix_micros(F.current_timestamp()) * 1000 if now is None else now
    names = ("tenant_id", "stream_labels", "body", "severity", "resource_attrs", "log_attrs", "parsed_fields", "trace_id", "span_id")
    rows = _accepted(_native(payloads))
    return canonical(rows.select("ingest_seq", F.coalesce("x.ns", now).alias("ts_ns"), *[F.col(f"x.e.{n}").alias(n) for n in names]))


def read_otlp(payloads: DataFrame, tenant: str = "default", now: Column | None = None) -> DataFrame:
    """OTLP logs: one row for each record. The tenant is the resource's `tenant_id`, or the given one. Refused payloads
    are left out."""
    now = F.unix_micros(F.current_timestamp()) * 1000 if now is None else now
    rows = _accepted(_otlp(payloads)).select("ingest_seq", "x.e", F.col("x.attributes").alias("of_resource"), F.col("x.e.attributes").alias("of_record"))
    rows = _with_attributes(_with_attributes(rows, "resource_attrs", "of_resource"), "log_attrs", "of_record")
    return canonical(
        rows.select(
            "ingest_seq", F.coalesce(_nanos(_otlp_time(F.col("e"))), now).alias("ts_ns"), text.first_non_blank(text.get("resource_attrs", "tenant_id"), F.lit(tenant)).alias("tenant_id"),
            any_value(F.col("e.body")).alias("body"), F.col("e.severityText").alias("severity"), "resource_attrs", "log_attrs",
            text.hex_id(F.col("e.traceId")).alias("trace_id"), text.hex_id(F.col("e.spanId")).alias("span_id"),
        )
    )


def read_loki(payloads: DataFrame, tenant: str = "default") -> DataFrame:
    """Loki push: [nanoseconds, line, metadata?] entries; those with fewer than two items are left out, and so are
    refused payloads."""
    v = F.col("x.v")
    metadata = F.when(F.size(v) > 2, F.create_map(F.lit("metadata"), F.get(v, F.lit(2))))
    return canonical(
        _accepted(_loki(payloads)).select(
            "ingest_seq", _nanos(F.get(v, F.lit(0))).alias("ts_ns"), F.lit(tenant).alias("tenant_id"),
            F.col("x.stream").alias("stream_labels"), F.get(v, F.lit(1)).alias("body"), metadata.alias("log_attrs"),
        )
    )
