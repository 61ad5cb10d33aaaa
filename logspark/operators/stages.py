"""Parse pipelines: ordered stages, each a step on columns of the event table.

Beside the event's columns the table has `dropped` (a filter stage took the event), `failed` (the stage that
rejected it, else null) and `errors` (names of the stages that failed, in order). A later stage leaves events alone
that are dropped or failed. Everything is a projection: no stage shuffles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regex, text
from ..functions.once import held
from ..schema import empty_map


@dataclass(frozen=True)
class Stage:
    name: str
    type: str
    config: dict[str, str] = field(default_factory=dict)


@dataclass
class Made:
    """What a stage makes: new columns and where it fails (None is nowhere). `steps` are helper columns that are worked
    out before, one after the other, so that what is used often is computed once."""

    columns: dict[str, Column] = field(default_factory=dict)
    fails: Column | None = None
    steps: tuple[dict[str, Column], ...] = ()


def _wrong() -> Made:
    """A stage whose settings are at fault fails for every event."""
    return Made(fails=F.lit(True))


def _json(_: dict) -> Made:
    """Every key of the body, which must be one JSON object, becomes a field; nested values stay JSON text."""
    # In brackets anything after the first value shows: as bad JSON, or as a second element.
    whole = F.try_parse_json(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    first, one = F.get("__values", F.lit(0)), F.coalesce(F.size("__values") == 1, F.lit(False))
    opened = {"__null": one & F.coalesce(F.is_variant_null(first), F.lit(False)), "__object": F.when(one, F.try_variant_get(first, "$", "map<string,variant>"))}
    typed = F.transform(F.map_entries("__object"), lambda e: F.struct(
        e["key"].alias("k"), F.schema_of_variant(e["value"]).alias("of"), e["value"].alias("v"), F.try_variant_get(e["value"], "$", "string").alias("shown")
    ))

    def shown(e: Column) -> Column:
        number = text.number_text(F.try_variant_get(e["v"], "$", "double"))
        return (
            F.when(e["of"] == "VOID", F.lit("<nil>"))
            .when((e["of"] == "BIGINT") & (F.length(e["shown"]) <= 15), e["shown"])
            .when(e["of"].isin("BIGINT", "DOUBLE", "FLOAT") | e["of"].startswith("DECIMAL"), number)
            .otherwise(e["shown"])
        )

    fields = F.map_from_entries(F.transform("__typed", lambda e: F.struct(e["k"], shown(e))))
    steps = ({"__values": F.try_variant_get(whole, "$", "array<variant>")}, opened, {"__typed": typed}, {"__fields": fields})
    merged = F.when(F.col("__fields").isNull(), F.col("parsed_fields")).otherwise(text.overlay(F.col("parsed_fields"), F.col("__fields")))
    return Made({"parsed_fields": merged}, F.col("__fields").isNull() & ~F.col("__null"), steps)


def _logfmt(_: dict) -> Made:
    """key=value between white space; quotes at both ends of a value go; the last of a key wins; nothing fails."""
    at = lambda t: F.instr(t, "=")
    tokens = F.filter(F.split("body", r"(?U)\s+"), lambda t: at(t) > 1)
    pairs = F.transform(tokens, lambda t: F.struct(F.substring(t, F.lit(1), at(t) - 1).alias("k"), F.btrim(F.substring(t, at(t) + 1, F.length(t)), F.lit('"')).alias("v")))
    steps = ({"__pairs": text.sorted_pairs(pairs)}, {"__fields": text.map_of_sorted("__pairs")})
    return Made({"parsed_fields": text.overlay(F.col("parsed_fields"), F.col("__fields"))}, steps=steps)


def _regex(config: dict) -> Made:
    """Named groups of the first match become fields; no match changes nothing."""
    if not config.get("pattern"):
        return _wrong()
    try:
        pattern, names = regex.to_java(config["pattern"])
    except ValueError:
        return _wrong()
    if not names:
        return Made()
    entries = F.map_from_entries(text_pairs([(name, F.regexp_extract("body", pattern, k)) for name, k in dict(names).items()]))
    merged = F.when(F.col("__fields").isNull(), F.col("parsed_fields")).otherwise(text.overlay(F.col("parsed_fields"), F.col("__fields")))
    return Made({"parsed_fields": merged}, steps=({"__fields": F.when(F.col("body").rlike(pattern), entries)},))


def text_pairs(pairs: list[tuple[str, Column]]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs])


def _static(config: dict) -> Made:
    """Keys `label.X` become labels, others fields."""
    labels = {k.removeprefix("label."): v for k, v in config.items() if k.startswith("label.")}
    fields = {k: v for k, v in config.items() if not k.startswith("label.") and k != "ignore_error"}
    made = {}
    for column, new in (("stream_labels", labels), ("parsed_fields", fields)):
        if new:
            entries = F.create_map(*[F.lit(x) for kv in new.items() for x in kv])
            made[column] = text.overlay(F.col(column), entries)
    return Made(made)


_RFC3339 = r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)\z"


def rfc3339_ns(x: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 time, or null."""
    good = x.rlike(_RFC3339)
    whole = F.try_to_timestamp(F.when(good, F.regexp_replace(x, r"\.\d+", "")))
    fraction = F.rpad(F.regexp_extract(x, r"\.(\d{1,9})", 1), 9, "0").cast("long")
    return F.when(good, F.unix_seconds(whole) * 1_000_000_000 + fraction)


def _timestamp(config: dict) -> Made:
    """rfc3339, unix (seconds, cut to whole ones) or unix_nano, in any case; an event without the field stays as it is."""
    if not config.get("source"):
        return _wrong()
    source, form = text.get("parsed_fields", config["source"]), (config.get("format") or "rfc3339").lower()
    value = F.col("__value")
    if form == "rfc3339":
        ns = rfc3339_ns(value)
    elif form in ("unix", "unix_seconds"):
        seconds = F.when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)\z"), value.try_cast("double"))
        ns = F.when(F.abs(seconds) < 9_223_372_036, seconds).cast("long") * 1_000_000_000
    elif form == "unix_nano":
        ns = F.when(value.rlike(r"^[+-]?\d+\z"), value.try_cast("long"))
    else:
        ns = F.lit(None).cast("long")
    steps = ({"__value": source}, {"__ns": ns})
    made = {"ts_ns": F.coalesce("__ns", "ts_ns"), "ts": F.coalesce(F.timestamp_micros(F.floor(F.col("__ns") / 1000)).cast("timestamp_ntz"), "ts")}
    return Made(made, (value != "") & F.col("__ns").isNull(), steps)


def _severity(config: dict) -> Made:
    value = F.lit(config["value"]) if config.get("value") else text.get("parsed_fields", config.get("source", ""))
    return Made({"severity": F.when(value == "", F.col("severity")).otherwise(text.severity(value))})


def anywhere(name: str) -> Column:
    """The first non-blank of an event's field, label, resource and log attribute of that name."""
    return text.first_non_blank(*[text.get(m, name) for m in ("parsed_fields", "stream_labels", "resource_attrs", "log_attrs")])


def _word(config: dict, key: str, default: str) -> str:
    """A setting in small letters; blank ones are the default."""
    value = config.get(key) or ""
    return (value if value.strip() else default).lower()


def _filter(config: dict) -> Made:
    name, value, op = config.get("field", ""), config.get("value", ""), _word(config, "op", "equals")
    have = anywhere(name)
    tests = {"equals": have == value, "not_equals": have != value, "contains": F.contains(have, F.lit(value))}
    if not name or op not in tests:
        return _wrong()
    return Made({"dropped": F.col("dropped") | tests[op]} if _word(config, "action", "drop") == "drop" else {})


def _rename(config: dict) -> Made:
    old, new = config.get("from"), config.get("to")
    column = {"label": "stream_labels", "parsed": "parsed_fields"}.get(_word(config, "target", "parsed"))
    if not old or not new or not column:
        return _wrong()
    m = F.col(column)
    return Made({column: F.when(F.map_contains_key(m, old), text.put(text.without(m, old), new, F.element_at(m, old))).otherwise(m)})


def _redact(config: dict) -> Made:
    name, target, instead = config.get("field"), _word(config, "target", "parsed"), config.get("replacement") or ""
    instead = instead if instead.strip() else "[REDACTED]"
    if not name or target not in ("parsed", "body"):
        return _wrong()
    if target == "body":
        return Made({"body": F.replace(F.col("body"), F.lit(name), F.lit(instead))})
    m = F.col("parsed_fields")
    return Made({"parsed_fields": F.transform_values(m, lambda k, v: F.when(k == name, F.lit(instead)).otherwise(v))})


STAGES: dict[str, Callable[[dict], Made]] = {
    "json": _json, "logfmt": _logfmt, "regex": _regex, "static": _static, "timestamp": _timestamp,
    "severity": _severity, "filter": _filter, "drop": _filter, "rename": _rename, "redact": _redact,
}


def run_stages(events: DataFrame, stages: list[Stage]) -> DataFrame:
    """Events -> events with `dropped`, `failed` and `errors`. A failing stage with ignore_error keeps what it made.

    Settings at fault (no pattern, unknown operation, ...) are errors of the stage, for each event; only an unknown
    type of stage is refused at once."""
    df = events.withColumns({"dropped": F.lit(False), "failed": F.lit(None).cast("string"), "errors": F.array().cast("array<string>")})
    for stage in stages:
        if stage.type not in STAGES:
            raise ValueError(f"unknown stage type {stage.type}")
        made = STAGES[stage.type](stage.config)
        for step in made.steps[:-1]:
            df = df.withColumns(step)
        for name, value in made.steps[-1].items() if made.steps else ():
            df = held(df, name, value)
        live = ~F.col("dropped") & F.col("failed").isNull()
        new = {c: F.when(live, v).otherwise(F.col(c)) for c, v in made.columns.items()}
        hits = []
        if made.fails is not None:
            wrong = live & F.coalesce(made.fails, F.lit(False))
            hits.append(wrong)
            if stage.config.get("ignore_error") != "true":
                new["failed"] = F.when(wrong, F.lit(stage.name)).otherwise(F.col("failed"))
        if "dropped" in made.columns:
            hits.append(live & made.columns["dropped"])
        if hits:
            hit = hits[0] if len(hits) == 1 else hits[0] | hits[1]
            new["errors"] = F.when(hit, F.array_append("errors", F.lit(stage.name))).otherwise(F.col("errors"))
        df = df.withColumns(new).drop(*[name for step in made.steps for name in step])
    return df


def promote(events: DataFrame, reserved: list[str], allow: list[str], deny: list[str]) -> DataFrame:
    """Reserved labels come from wherever an event has them first; allowed fields become labels where none is; the
    severity becomes one where none is. Dropped and failed events, if marked, stay as they are."""
    places = ("stream_labels", "parsed_fields", "resource_attrs", "log_attrs")
    found = text_pairs([(name, text.first_non_blank(*[text.get(m, name) for m in places])) for name in dict.fromkeys(reserved)]) if reserved else None
    taken = F.map_from_entries(F.filter(found, lambda p: p["v"] != "")) if reserved else empty_map()
    allowed = F.map_filter("parsed_fields", lambda k, v: k.isin(*allow) & ~k.isin(*deny) & ~text.blank(v)) if allow else empty_map()
    df = events.withColumns({"__taken": taken, "__allowed": allowed})
    df = df.withColumn("__own", F.map_filter(text.overlay(F.col("stream_labels"), F.col("__taken")), lambda _, v: ~text.blank(v)))
    df = held(df, "__labels", text.overlay(F.col("__allowed"), F.col("__own")))
    labels = F.col("__labels")
    if "severity" in reserved or "severity" in allow:
        labels = F.when((text.get("__labels", "severity") == "") & (F.col("severity") != ""), text.put(labels, "severity", F.col("severity"))).otherwise(labels)
    live = ~F.col("dropped") & F.col("failed").isNull() if "failed" in events.columns else F.lit(True)
    df = df.withColumn("stream_labels", F.when(live, labels).otherwise(F.col("stream_labels")))
    return df.drop("__taken", "__allowed", "__own", "__labels")


def stage_stats(events: DataFrame) -> DataFrame:
    """stage, errors: how often each stage failed or dropped."""
    return events.select(F.explode("errors").alias("stage")).groupBy("stage").agg(F.count("*").alias("errors"))


def violation(max_labels: int = 12, max_body: int = 262_144, max_fields: int = 64, max_value: int = 2048) -> Column:
    """The first rule that an event breaks, or null. Lengths are bytes; a limit of 0 is none."""
    labels, fields = F.col("stream_labels"), F.col("parsed_fields")
    long_value = lambda m: F.exists(F.map_values(m), lambda v: F.octet_length(v) > max_value)
    rules = [
        ("timestamp", F.col("ts_ns").isNull()), ("tenant", text.blank(F.col("tenant_id"))), ("body", text.blank(F.col("body"))),
        ("label", F.exists(F.map_entries(labels), lambda e: text.blank(e["key"]) | text.blank(e["value"]))),
    ]
    rules += [("label_count", F.size(labels) > max_labels)] if max_labels else []
    rules += [("body_bytes", F.octet_length("body") > max_body)] if max_body else []
    rules += [("field_count", F.size(fields) > max_fields)] if max_fields else []
    rules += [("label_value", long_value(labels)), ("field_value", long_value(fields))] if max_value else []
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules])
