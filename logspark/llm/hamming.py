"""All pairs of 64-bit fingerprints within a Hamming radius, by tables of masks that cover every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def hamming_links(fps: DataFrame, radius: int, families: list[list[int]], most: int = 256) -> DataFrame:
    """fps (fp long, distinct) -> a long, b long as a table: all pairs that differ in at most `radius` bits, a < b.

    Each family of masks covers every pair: two fingerprints within the radius agree under at least one of its masks.
    Fingerprints that agree under a mask form a bucket. Buckets of up to `most` are compared pair by pair. Those in
    larger ones, which are clusters of near fingerprints, are put into the buckets of the next family, whose masks
    are longer. The last family's buckets are compared whole: they hold at most 2^(bits that its masks leave out).
    So no bucket is capped. Repeated pairs come once; no fingerprints give no pairs."""
    rows, pairs, read = fps.select("fp"), None, []
    for level, masks in enumerate(families):
        last = level + 1 == len(families)
        rows = rows.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
        # One number for mask and agreed bits; numbers that meet by chance only cost a comparison.
        rows = rows.select("fp", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
        rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("key")))
        # Both sides of the join come from the one shuffle that the counts need.
        small = rows.where("n > 1") if last else rows.where(F.col("n").between(2, most))
        x, y = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
        near = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
        pairs = near if pairs is None else pairs.unionByName(near)
        if not last:
            rows = materialise(rows.where(F.col("n") > most).select("fp").distinct(), "large-buckets")
            read.append(rows)
        if last or rows.isEmpty():
            break
    found = materialise(pairs.distinct(), "near")
    discard(*read)
    return found
