"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint is hashed under structured bit masks (Pagh, 2016): each bit gets a non-zero vector of
F_2^(radius + 1), and for each non-zero v of that space a mask has the bits whose vectors have inner product 1
with v. Any set of up to `radius` vectors has a common orthogonal v, so two fingerprints that differ in at most
`radius` bits agree under at least one mask: no link is lost."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, text_bytes
from .components import connected_components
from .hamming import hamming_links

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42, step: int = 1 << 16) -> int:
    """A bit is 1 if set in over half of the XXH64 of all shingles; without words 0."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1], ends[k - 1 :]
    set_bits = np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    for at in range(0, len(first), step):
        own = [h(joined[s:e], seed) for s, e in zip(first[at : at + step].tolist(), last[at : at + step].tolist())]
        bits = np.unpackbits(np.array(own, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * set_bits > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id long, fp long (the 64 bits as a signed number), a row for each row."""

    def batch_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column("text"))], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batch_of, "doc_id long, fp long")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions such that any `radius` of them are all outside at least one mask."""
    size = (1 << (radius + 1)) - 1
    return [sum(1 << b for i, b in enumerate(bits) if bin((i % size + 1) & v).count("1") % 2) for v in range(1, size + 1)]


def covering_families(radius: int) -> list[list[int]]:
    """Covering masks, and longer ones: each of them with those that cover the bits that it leaves out."""
    first = covering_masks(list(range(64)), radius)
    return [first, [m | more for m in first for more in covering_masks([i for i in range(64) if not m >> i & 1], radius)]]


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id long, fingerprint string, component_id long, a row for each row.

    Documents whose fingerprints differ in at most `radius` bits are linked; component_id is the smallest doc_id
    reachable. Texts without words (null, empty, blank) all have fingerprint zero and are linked. Copies share a
    fingerprint and are never expanded into pairs. Repeated rows each give a row; null doc_ids are no one's
    component_id unless a component has no other (then it is null). Other columns are ignored."""
    own = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("low"))
    groups = connected_components(hamming_links(distinct, radius, covering_families(radius)))
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialise(named, "fingerprint-groups")
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "component").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component: those with its smallest doc_id.

    Of repeated rows of one doc_id the first in the order of their text stays. Rows with a null doc_id can't stand
    for a component or be told apart, and all stay."""
    parts = simhash_components(docs, shingle, radius)
    others = parts.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    left = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    order = Window.partitionBy("doc_id").orderBy("text")
    named = left.where("doc_id IS NOT NULL").select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    named = named.withColumn("of_id", F.row_number().over(order)).where("of_id = 1").select("row.*")
    return named.unionByName(left.where("doc_id IS NULL"))
