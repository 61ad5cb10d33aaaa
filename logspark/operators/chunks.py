"""Chunks of streams, their summaries, and pruning by them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def numbered(events: DataFrame) -> DataFrame:
    """Adds `stream_key`, `bucket` and `at`, from 0, the place in the stream by time and arrival.

    A stream is counted bucket by bucket and shifted by earlier buckets' counts, so no task holds a whole stream."""
    rows = events.withColumns({"stream_key": text.stream_key("tenant_id", "stream_labels"), "bucket": text.bucket(F.col("ts"))})
    sums = rows.groupBy("stream_key", "bucket").agg(F.count("*").alias("n"))
    lower = Window.partitionBy("stream_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("stream_key", "bucket", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("lower"))
    own = F.row_number().over(Window.partitionBy("stream_key", "bucket").orderBy("ts_ns", "ingest_seq")) - 1
    return rows.withColumn("own", own).join(sums, ["stream_key", "bucket"]).withColumn("at", F.col("own") + F.col("lower")).drop("own", "lower")


def estimated_bytes() -> Column:
    texts = [F.col(c) for c in ("severity", "trace_id", "span_id", "tenant_id")]
    return text.stored_bytes(F.col("body"), texts, [F.col("stream_labels"), F.col("parsed_fields")])


#: Where a search for fields looks.
_SEARCHED = ("parsed_fields", "log_attrs", "resource_attrs")


#: What tells the chunks of segment_summaries apart.
SEGMENT = ("tenant_id", "stream_key", "bucket", "day", "labels_hash")


def _segmented(events: DataFrame) -> DataFrame:
    # A label's value may hold what stands between labels in a stream's key, so the labels themselves count, too.
    own = F.xxhash64(F.array_sort(F.map_entries("stream_labels")))
    return events.withColumns({"stream_key": text.stream_key("tenant_id", "stream_labels"), "bucket": text.bucket(F.col("ts")), "day": F.to_date("ts"), "labels_hash": own})


def segment_tokens(events: DataFrame) -> DataFrame:
    """A row for each token of each chunk of segment_summaries, so that no chunk's tokens are ever held together."""
    return _words(_segmented(events), SEGMENT)


def segment_summaries(events: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Summaries by tenant, day, stream and hour, the chunks that pruned searches leave out; without the tokens, which
    may be given as the table of segment_tokens."""
    return summaries(_segmented(events), *SEGMENT, words=tokens).drop("tokens")


def _words(chunked: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return chunked.select(*keys, F.explode(F.array_distinct(text.tokens(F.col("body")))).alias("token")).distinct()


def summaries(chunked: DataFrame, *keys: str, words: DataFrame | None = None) -> DataFrame:
    """A row for each chunk: events, bytes, time range, labels (all events of a stream have the same), names of its
    parsed fields and of all that a search for fields looks at, tokens and a 256-bit bloom filter of them."""
    base = chunked.groupBy(*keys).agg(
        F.count("*").alias("event_count"), F.sum(estimated_bytes()).alias("bytes"), F.min("ts_ns").alias("min_ts_ns"), F.max("ts_ns").alias("max_ts_ns"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("parsed_fields"))))).alias("field_names"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.concat(*[F.map_keys(m) for m in _SEARCHED])))))).alias("searchable"),
        F.first("stream_labels").alias("stream_labels"),
    )
    words = _words(chunked, keys) if words is None else words
    bits = words.withColumn("bits", text.bloom_bits(F.col("token")))
    lanes = [F.bit_or(F.expr(f"shiftleft(1L, bits[{i}])")).alias(f"bloom_{i}") for i in range(4)]
    blooms = bits.groupBy(*keys).agg(F.array_sort(F.collect_set("token")).alias("tokens"), *lanes)
    return base.join(blooms, list(keys), "left")


def whole_tokens(needle: str) -> list[str]:
    """Tokens of a wanted text with something else on both sides: where the text is, they are whole tokens too."""
    parts = re.split("[^a-z0-9]+", needle.lower())
    return [t for t in parts[1:-1] if t]


def may_contain(needle: str) -> Column:
    """Whether a summary's bloom filter has every token of the needle: whole tokens only, so use it where the
    needle isn't part of a longer token. Without tokens everything may."""
    found = F.lit(True)
    for token in [t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in needle.lower()).split() if t]:
        bits = text.bloom_bits(F.lit(token))
        for i in range(4):
            lane = F.coalesce(F.col(f"bloom_{i}"), F.lit(0)).cast("long")
            found &= F.call_function("shiftright", lane, bits[i]).bitwiseAND(F.lit(1)) == 1
    return found


def build_chunks(events: DataFrame, max_events: int = 1000, max_bytes: int = 262_144, max_ns: int = 60_000_000_000) -> DataFrame:
    """Events -> ingest_seq, stream_key, chunk: a chunk ends with the event that brings it to max_events or max_bytes,
    or that comes max_ns after its first. Streams are cut in order of arrival, whatever the hour.

    Where a chunk ends depends on where the last did, so a stream's rows are read in order, batch by batch; a task
    remembers three numbers and holds no stream whole."""
    rows = events.select("ingest_seq", "ts_ns", text.stream_key("tenant_id", "stream_labels").alias("stream_key"), estimated_bytes().alias("bytes"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, chunk, n, size, first = None, 0, 0, 0, 0
        for b in batches:
            out = []
            for key, ts, own in zip(b["stream_key"], b["ts_ns"], b["bytes"]):
                if key != stream:
                    stream, chunk, n = key, 0, 0
                if not n:
                    size, first = 0, ts
                n, size = n + 1, size + own
                out.append(chunk)
                if n >= max_events or size >= max_bytes or ts - first >= max_ns:
                    chunk, n = chunk + 1, 0
            yield b[["ingest_seq", "stream_key"]].assign(chunk=out)

    dealt = rows.repartition("stream_key").sortWithinPartitions("stream_key", "ingest_seq")
    return dealt.mapInPandas(assign, "ingest_seq long, stream_key string, chunk long")
