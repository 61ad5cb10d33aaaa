"""URL filters against a list that changes over time, with DataFrame operations only.

Dated list entries (a pattern is added or removed on a day) become validity intervals, and every capture is held
against the entries that were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

_HOST = r"^[a-z][a-z0-9+.\-]*://([^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)"
_SEGMENT = r"^[a-z][a-z0-9+.\-]*://[^/?#]*/([^/?#]+)"
_ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*)$"


def host(url: Column) -> Column:
    """The host in small letters, without user, port and final dot; empty if there is none."""
    return F.rtrim(F.coalesce(F.regexp_extract(F.lower(url), _HOST, 2), F.lit("")), F.lit("."))


def domains(host: Column) -> Column:
    """A host and all domains above it, down to two labels. An address is in no domain."""
    labels = F.split(host, r"\.")
    upper = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.when((F.size(labels) < 2) | host.rlike(_ADDRESS), F.array().cast("array<string>")).otherwise(upper)


def place(url: Column) -> Column:
    """Host and first path segment, or empty."""
    segment = F.coalesce(F.regexp_extract(F.lower(url), _SEGMENT, 1), F.lit(""))
    return F.when(segment != "", F.concat(host(url), F.lit("/"), segment)).otherwise("")


def validity(entries: DataFrame) -> DataFrame:
    """entries (pattern, day date, active boolean) -> pattern, spells: array of (from, until), a row for each pattern.

    Patterns count in small letters, without a final dot. An entry holds from its day until the pattern's next; of
    several on one day a removal counts. Rows with a null
    or an empty pattern are left out. A pattern's history is as long as the list's own, whatever is captured."""
    entries = entries.withColumn("pattern", F.rtrim(F.lower("pattern"), F.lit(".")))
    days = entries.where("pattern <> '' AND day IS NOT NULL").groupBy("pattern", "day").agg(F.min(F.coalesce("active", F.lit(False))).alias("active"))
    until = F.coalesce(F.lead("day").over(Window.partitionBy("pattern").orderBy("day")), F.lit("9999-12-31").cast("date"))
    spells = days.select("pattern", F.col("day").alias("from"), until.alias("until"), "active").where("active")
    return spells.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("from", "until"))).alias("spells"))


def filter_urls(captures: DataFrame, entries: DataFrame, small: int = 100_000) -> DataFrame:
    """captures (url, fetched date, ...) and entries -> captures' columns, host, by_host, by_domain, by_place, blocked.

    A row for each row. Each of the three says that the list held the URL's host, its host or a domain above it (of two
    labels or more), or its host and first path segment on the day of the fetch. A null or malformed URL, and a null
    day, match nothing; addresses are in no domain. Each host's domains are looked up once, whatever its captures. The
    list, and what it says of hosts, are broadcast up to `small` rows. Beyond that they are joined by key, and a host
    that many captures share is then split by adaptive execution: both sides of each join come straight from a
    shuffle. Columns of captures that have one of these names give way."""
    spells = materialise(validity(entries), "validity")
    made = ("host", "by_host", "by_domain", "by_place", "blocked")
    rows = captures.select(F.struct(*captures.columns).alias("row"), host(F.col("url")).alias("host"), place(F.col("url")).alias("place"), F.col("fetched").alias("on"))
    hosts = rows.where("host <> ''").select("host").distinct().withColumn("pattern", F.explode(domains(F.col("host"))))
    above = hosts.join(spells, "pattern").groupBy("host").agg(F.flatten(F.collect_list("spells")).alias("above"))  # as many as the host has labels
    above = materialise(above, "hosts")
    small_list, small_hosts = spells.count() <= small, above.count() <= small
    tables = {
        "by_host": (spells.withColumnRenamed("pattern", "host"), "host", "spells", small_list), "by_domain": (above, "host", "above", small_hosts),
        "by_place": (spells.withColumnRenamed("pattern", "place"), "place", "spells", small_list),
    }
    for name, (table, key, held, few) in tables.items():
        rows = rows.join(F.broadcast(table) if few else table, key, "left")
        active = F.exists(held, lambda s: (F.col("on") >= s["from"]) & (F.col("on") < s["until"]))
        rows = rows.withColumn(name, F.coalesce(active, F.lit(False))).drop(held)
    return rows.withColumn("blocked", F.col("by_host") | F.col("by_domain") | F.col("by_place")).select(
        *[F.col("row")[c].alias(c) for c in captures.columns if c not in made], *made
    )
