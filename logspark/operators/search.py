"""Search over event tables: conjunctive predicates, order, pages, tail, and stored and new events together."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regex, text
from .chunks import SEGMENT, may_contain, whole_tokens

#: What makes two rows one event; severity and parsed fields don't count.
IDENTITY = ("tenant_id", "ts_ns", "stream_key", "body", "trace_id", "span_id")


@dataclass(frozen=True)
class Query:
    """All given conditions must hold. Both ends of the time range are in it. A limit of 0 is none. `bucket` is the
    one hour to look at, YYYY-MM-DD/HH."""

    tenant_id: str
    start_ns: int
    end_ns: int
    labels: dict[str, str] = field(default_factory=dict)
    fields: dict[str, str] = field(default_factory=dict)
    contains: str = ""
    regex: str = ""
    limit: int = 0
    cursor: str = ""
    tail: bool = False
    bucket: str = ""

    def __post_init__(self) -> None:
        if not self.tenant_id.strip():
            raise ValueError("a tenant is required")
        if self.end_ns < self.start_ns:
            raise ValueError("the end lies before the start")
        if self.limit < 0 or (self.cursor and not self.cursor.isdecimal()):
            raise ValueError("limit and cursor must be non-negative numbers")
        if self.bucket:
            self.hour  # noqa: B018
        if self.regex:
            regex.checked(self.regex)

    @property
    def hour(self) -> datetime:
        return datetime.strptime(self.bucket, "%Y-%m-%d/%H")

    @property
    def offset(self) -> int:
        return int(self.cursor or 0)


def tail(tenant_id: str, now_ns: int, since_ns: int | None = None, limit: int = 100, **conditions) -> Query:
    """The newest events first, of the last five minutes unless `since_ns` is given."""
    start = now_ns - 300_000_000_000 if since_ns is None else since_ns
    return Query(tenant_id, start, now_ns, limit=limit if limit > 0 else 100, tail=True, **conditions)


def in_time(q: Query, days: bool = False) -> Column:
    """Tenant and time on plain columns that a scan can prune by; with `days` also on the partition column `day`."""
    low, high = (F.timestamp_micros(F.lit(x)).cast("timestamp_ntz") for x in (q.start_ns // 1000 - 1, q.end_ns // 1000 + 1))
    found = (F.col("tenant_id") == q.tenant_id) & F.col("ts").between(low, high) & F.col("ts_ns").between(q.start_ns, q.end_ns)
    if q.bucket:
        found &= (F.col("ts") >= F.lit(q.hour).cast("timestamp_ntz")) & (F.col("ts") < F.lit(q.hour + timedelta(hours=1)).cast("timestamp_ntz"))
    return found & on_days(q) if days else found


def on_days(q: Query) -> Column:
    """The days of the time range, as dates that are known before the scan."""
    first, last = (datetime(1970, 1, 1) + timedelta(microseconds=x // 1000) for x in (q.start_ns, q.end_ns))
    if q.bucket:
        first, last = max(first, q.hour), min(last, q.hour)
    return F.col("day").between(F.lit(first.date()), F.lit(last.date()))


def matches(q: Query, days: bool = False) -> Column:
    """The whole predicate; with `days` for tables that are stored by day."""
    found = in_time(q, days)
    for k, v in sorted(q.labels.items()):
        found &= text.get("stream_labels", k) == v
    for k, v in sorted(q.fields.items()):
        found &= (text.get("parsed_fields", k) == v) | (text.get("log_attrs", k) == v) | (text.get("resource_attrs", k) == v)
    if q.contains:
        found &= F.contains(F.lower("body"), F.lower(F.lit(q.contains)))
    if q.regex:
        found &= F.col("body").rlike(regex.to_java(q.regex)[0])
    return found


def ordered(events: DataFrame, newest_first: bool = False) -> DataFrame:
    """By time, then stored before new, then arrival; newest first reverses time and arrival."""
    if newest_first:
        return events.orderBy(F.desc("ts_ns"), F.desc("ingest_seq"))
    return events.orderBy("ts_ns", "tier", "ingest_seq")


def search(events: DataFrame, q: Query) -> DataFrame:
    """One page in order; with a limit Spark keeps the smallest rows of each partition and sorts no more."""
    rows = ordered(events.where(matches(q, "day" in events.columns)), q.tail)
    rows = rows.offset(q.offset) if q.offset else rows
    return rows.limit(q.limit) if q.limit else rows


def candidates(summaries: DataFrame, q: Query, tokens: DataFrame | None = None) -> DataFrame:
    """The chunk summaries (see chunks.segment_summaries) that may hold a match: tenant, days and hour, time range,
    labels, names of the wanted fields, and the bloom filter for tokens that stand whole in the wanted text. Parts of
    it at its ends may be parts of longer tokens, so nothing that matches is left out.

    The filter lets more chunks pass the more tokens they have; with the table of chunks.segment_tokens only those stay
    that have all of them."""
    found = (F.col("tenant_id") == q.tenant_id) & on_days(q) & (F.col("min_ts_ns") <= q.end_ns) & (F.col("max_ts_ns") >= q.start_ns)
    if q.bucket:
        found &= F.col("bucket") == q.bucket
    for k, v in sorted(q.labels.items()):
        found &= text.get("stream_labels", k) == v
    for k, v in sorted(q.fields.items()):
        found &= F.array_contains("searchable", k) if v else F.lit(True)  # an empty value also matches where no field is
    if q.contains and not q.regex:
        found &= may_contain(" ".join(whole_tokens(q.contains)))
    found = summaries.where(found)
    wanted = sorted(set(whole_tokens(q.contains))) if q.contains and not q.regex and tokens is not None else []
    if not wanted:
        return found
    hits = tokens.where((F.col("tenant_id") == q.tenant_id) & on_days(q) & F.col("token").isin(wanted))
    whole = hits.groupBy(*SEGMENT).agg(F.countDistinct("token").alias("n")).where(F.col("n") == len(wanted))
    return found.join(whole, list(SEGMENT), "left_semi")


def pruned_search(events: DataFrame, summaries: DataFrame, q: Query, tokens: DataFrame | None = None) -> DataFrame:
    """search() over a table of write_events, of which only candidate chunks' events are looked at."""
    keys = ["tenant_id", "day", "stream_key", "bucket"]
    narrow = events.where(in_time(q, days=True)).join(candidates(summaries, q, tokens).select(*keys), keys, "left_semi")
    return search(narrow, q)


def explain(summaries: DataFrame, q: Query, tokens: DataFrame | None = None) -> DataFrame:
    """candidate_chunks, candidate_streams, candidate_events, and cost: chunks times one and the number of label and
    field conditions. Only summaries, and if given the table of their tokens, are read."""
    weight = 1 + len(q.labels) + len(q.fields)
    return candidates(summaries, q, tokens).agg(
        F.count("*").alias("candidate_chunks"), F.countDistinct("stream_key").alias("candidate_streams"),
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("candidate_events"), (F.count("*") * weight).alias("cost"),
    )


def page_summary(events: DataFrame, q: Query) -> DataFrame:
    """matched, next_cursor: how many events match in all, and where the next page begins, or empty after the last.
    It counts and sorts nothing."""
    total = events.where(matches(q, "day" in events.columns)).agg(F.count("*").alias("matched"))
    more = F.lit(str(q.offset + q.limit)) if q.limit else F.lit("")
    return total.select("matched", F.when(F.col("matched") > q.offset + q.limit, more).otherwise("").alias("next_cursor"))


def next_cursor(events: DataFrame, q: Query) -> str:
    """The cursor of the next page, or empty after the last."""
    return page_summary(events, q).first()["next_cursor"] if q.limit else ""


def merged(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new events, one row for each identity: the stored one, or of those the first that arrived.

    Rows are dealt by all identity columns, so a busy tenant or stream spreads over many tasks."""
    own = [c for c in stored.columns if c in new.columns]  # a stored table's day and the like are left out
    both = stored.select(*own).unionByName(new.select(*own)).withColumn("stream_key", text.stream_key("tenant_id", "stream_labels"))
    first = Window.partitionBy(*IDENTITY).orderBy("tier", "ingest_seq")
    return both.withColumn("of_identity", F.row_number().over(first)).where("of_identity = 1").drop("of_identity")


def candidate_stats(events: DataFrame, q: Query) -> DataFrame:
    """candidate_rows, candidate_streams: what tenant, time and labels leave before fields and text."""
    narrow = replace(q, fields={}, contains="", regex="")
    keys = events.where(matches(narrow)).select(text.stream_key("tenant_id", "stream_labels").alias("stream_key"))
    return keys.agg(F.count("*").alias("candidate_rows"), F.countDistinct("stream_key").alias("candidate_streams"))


def postings(events: DataFrame, maps: str = "stream_labels") -> DataFrame:
    """key, value, events: how many events carry each value."""
    return events.select(F.explode(maps).alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("events"))


def intersect_postings(events: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """ingest_seq of the events that carry all wanted labels, from the postings themselves."""
    rows = events.select("ingest_seq", F.explode("stream_labels").alias("key", "value"))
    hits = rows.where(F.concat_ws("\x1f", "key", "value").isin(*[f"{k}\x1f{v}" for k, v in wanted.items()]))
    return hits.groupBy("ingest_seq").agg(F.countDistinct("key").alias("n")).where(F.col("n") == len(wanted)).select("ingest_seq")
