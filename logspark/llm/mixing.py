"""Mixing sources to target weights with DataFrame operations only.

Each source's documents lie in permuted blocks (by a hash of the doc_id). What the mix takes of a source is a number
of its blocks: all of them as many times over as its target asks, and of the last round the first blocks up to the
quota. A splitting tree deals these numbers to output shards: at each node the counts of all sources are split by one
multivariate-hypergeometric draw, down to a quota of blocks for each source and shard. The shards then draw their
quotas from each source's blocks one after the other, so that no two have the same, and shuffle what they drew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, materialise


def _random(*parts: Column | str) -> Column:
    """60 bits that depend on the parts only, so that reruns and other engines agree."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """__key, source, source_size (a row for each source) -> with target double.

    Sources in code point order, null last, weigh `weights`, repeating. Together they get `share` times all sizes,
    by weight; none gets over `most` times its size, and the excess is shared again by weight among the others. The
    end of that resharing is min(most * size, level * weight) for the one level that adds up. Windows here run over
    one row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("full_at", F.col("cap") / F.col("w"))
    rows = rows.withColumn("before", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    rows = rows.withColumn("level", (total - F.col("before")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source", "level"))).over(Window.partitionBy())["level"]
    return rows.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))).select("__key", "source", "source_size", "target")


def shard_quotas(counts: DataFrame, shards: int, seed: str) -> DataFrame:
    """counts (key, n: blocks of a source) -> shard, key, n: how many of them each shard gets; shards is a power of 2.

    At each node a random half of all its blocks goes left, and how many of each source are among them is the draw.
    Random numbers are ranked by their first 12 bits, whose counts are summed, and then within those 12 bits, so a
    task ranks a 4096th of a node's blocks."""
    node = counts.select(F.lit(0).alias("shard"), "key", "n")
    for level in range((shards - 1).bit_length()):
        balls = node.select("shard", "key", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("ball"))
        balls = balls.withColumn("u", _random(seed, str(level), F.col("shard"), F.col("key"), F.col("ball"))).withColumn("part", F.shiftright("u", 48))
        parts = balls.groupBy("shard", "part").agg(F.count("*").alias("of_part"))
        before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("shard", "part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("lower"), F.sum("of_part").over(Window.partitionBy("shard")).alias("all"))
        rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("u", "key", "ball")) + F.col("lower")
        left = balls.join(parts, ["shard", "part"]).withColumn("left", rank * 2 <= F.col("all") + 1).groupBy("shard", "key").agg(F.count_if("left").alias("left"), F.count_if(~F.col("left")).alias("right"))
        halves = F.explode(F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("n")), F.struct((F.col("shard") * 2 + 1).alias("shard"), F.col("right").alias("n"))))
        node = materialise(left.select("key", halves.alias("half")).select("half.shard", "key", "half.n").where("n > 0"), "tree-level")
    return node


def _plan(sums: DataFrame, targets: DataFrame, shards: int, seed: str) -> DataFrame:
    """sums (key, block, words) and targets -> a row for each block: what is taken of it, and for which shards."""
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    plan = sums.join(targets, "key").withColumns({
        "lower": F.coalesce(F.sum("words").over(before), F.lit(0)), "at": F.count("*").over(before), "of_source": F.count("*").over(Window.partitionBy("key"))
    })
    plan = plan.withColumn("rounds", (F.col("whole") + (F.col("lower") < F.col("quota")).cast("long")).cast("int"))
    plan = materialise(plan, "mix-blocks")
    quotas = materialise(shard_quotas(plan.groupBy("key").agg(F.sum("rounds").alias("n")).where("n > 0"), shards, seed), "shard-quotas")
    # A source's draws lie in a row: shard by shard, round by round. The shard whose draws begin last before a draw has it.
    begins = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begins = quotas.select("key", F.coalesce(F.sum("n").over(begins), F.lit(0)).alias("draw"), F.lit(0).alias("round"), F.lit(None).cast("long").alias("block"), F.col("shard").cast("int").alias("shard"))
    draws = plan.where("rounds > 0").select("key", "block", "at", "of_source", F.explode(F.sequence(F.lit(1), F.col("rounds"))).alias("round"))
    draws = draws.select("key", ((F.col("round") - 1) * F.col("of_source") + F.col("at")).alias("draw"), "round", "block", F.lit(None).cast("int").alias("shard"))
    order = Window.partitionBy("key").orderBy("draw", "round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = begins.unionByName(draws).withColumn("shard", F.max("shard").over(order)).where("round > 0")
    dealt = drawn.groupBy("key", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("round", "shard"))), lambda x: x["shard"]).alias("dealt"))
    return plan.join(dealt, ["key", "block"]).select("key", "block", "words", "whole", "lower", "quota", "dealt")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    blocks: int | None = None, shards: int = 16, seed: str = "mix", carry: bool = False,
) -> DataFrame:
    """docs (doc_id, text, source, ...) -> doc_id, size, source_size, target, taken, shards.

    A row for each row; with `carry` also `row`, a struct of all its columns. `size` is the text's words (null: 0).
    `taken` is how many of a row's words the mix takes, with repeats: those of the blocks that the shards draw, so over
    a source they add up to its target, rounded down. A row is taken whole but for one of each source, of which only as
    many words are as the quota has left (repeated rows share what is left, rounded down). `shards` lists the output
    shard of each time it is taken. Null sources are one source; a null doc_id is a doc_id like others; other columns
    are ignored. An empty table gives no rows. Each source has `blocks` blocks, a power of 2; unless given there are
    enough for some 50,000 rows each. Texts are read twice and not shuffled."""
    carried = [F.struct(*docs.columns).alias("row")] if carry else []
    blocks = blocks or max(256, 1 << (docs.count() // 50_000).bit_length())
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    place = _random(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), key.alias("key"), place.alias("place"), *carried)
    rows = rows.withColumn("block", F.shiftright("place", 60 - (blocks - 1).bit_length()))

    sums = materialise(rows.groupBy("key", "source", "block").agg(F.sum("size").alias("words")), "blocks")
    targets = source_targets(sums.groupBy(F.col("key").alias("__key"), "source").agg(F.sum("words").alias("source_size")), weights, share, most)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("quota", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")).withColumnRenamed("__key", "key")
    targets = materialise(targets.drop("source"), "mix-targets")
    plan = materialise(_plan(sums.drop("source"), targets.select("key", "whole", "quota"), shards, seed), "mix-plan")

    # One block of each source is taken in part: where its rows, in the order of their places, reach the quota.
    split = plan.where("lower < quota AND lower + words > quota").select("key", "block", (F.col("quota") - F.col("lower")).alias("need"))
    ties = rows.select("key", "block", "place", "size").join(F.broadcast(split) if _few(split) else split, ["key", "block"]).groupBy("key", "place", "size", "need").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0)))
    cut = ties.where("before < need AND before + size * n >= need").selectExpr("key", "struct(place, size) AS cut", "floor((need - before) / n) AS rest")
    plan = materialise(plan.join(cut, "key", "left"), "mix-cuts")
    sources = targets.select("key", "source_size", "target")

    out = rows.join(F.broadcast(plan) if _few(plan) else plan, ["key", "block"], "left")
    out = out.join(F.broadcast(sources) if _few(sources) else sources, "key")
    part = F.expr(
        "CASE WHEN lower IS NULL OR lower >= quota THEN 0 WHEN lower + words <= quota THEN size "
        "WHEN struct(place, size) < cut THEN size WHEN struct(place, size) = cut THEN rest ELSE 0 END"
    )
    out = out.withColumn("part", part).withColumn("whole", F.coalesce("whole", F.lit(0)))
    return out.select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        F.slice(F.coalesce("dealt", F.array().cast("array<int>")), 1, (F.col("whole") + (F.col("part") > 0).cast("long")).cast("int")).alias("shards"),
        *[F.col(c) for c in ("row",) if carry],
    )


def _few(table: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table may be broadcast: at some 100 bytes a row, up to 10 MB."""
    return table.limit(rows + 1).count() <= rows


def mixed_rows(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them, shard by shard and in a random order
    within each: rows of a shard lie together, in pieces of some 10,000 rows.

    The one row of a source that the quota cuts comes whole if it has at least half of its words in it, and otherwise
    not; rows without words come as often as their source is taken whole. An empty table gives no rows."""
    mix = mix_sources(docs, seed=seed, carry=True, **how)
    times = F.when(F.col("size") > 0, F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2))).otherwise(F.size("shards")).cast("int")
    copies = mix.select("row", "doc_id", F.posexplode(F.slice("shards", 1, times)).alias("copy", "shard"))
    pieces = 1 << (docs.count() // (10_000 * how.get("shards", 16))).bit_length()
    copies = copies.withColumn("place", _random(seed, "place", F.col("shard"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy")))
    copies = copies.withColumn("piece", F.shiftright("place", 60 - (pieces - 1).bit_length()))
    return copies.repartition("shard", "piece").sortWithinPartitions("shard", "place").select("row.*")
