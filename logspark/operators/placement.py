"""Placement of stream keys on members by rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score(key: Column, member: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, member), 256)


def place(keys: DataFrame, members: list[tuple[str, str]], copies: int = 2) -> DataFrame:
    """keys (key) -> key, fingerprint, members: the `copies` ready members of highest score, the primary first.

    members: (id, state). The list is part of the plan, as large as the ring, so nothing is joined or shuffled."""
    ready = sorted({m for m, state in members if state == "ready"})
    scored = F.array(*[F.struct(score(F.col("key"), F.lit(m)).alias("s"), F.lit(m).alias("m")) for m in ready])
    best = F.array_sort(scored, lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["m"] < b["m"], -1).otherwise(1))
    chosen = F.transform(F.slice(best, 1, copies), lambda x: x["m"]) if ready else F.array().cast("array<string>")
    return keys.select("key", F.sha2("key", 256).alias("fingerprint"), chosen.alias("members"))


def assignments(placed: DataFrame) -> DataFrame:
    """key, member, role: a row for each copy."""
    rows = placed.select("key", F.posexplode("members").alias("at", "member"))
    return rows.select("key", "member", F.when(F.col("at") == 0, "primary").otherwise("replica").alias("role"))


def balance(placed: DataFrame) -> DataFrame:
    """member, primaries, replicas."""
    return assignments(placed).groupBy("member").agg(
        F.count_if(F.col("role") == "primary").alias("primaries"), F.count_if(F.col("role") == "replica").alias("replicas")
    )


def reconcile(desired: DataFrame, current: DataFrame) -> DataFrame:
    """Both (key, member) -> key, member, action: upsert what is desired and not there, delete what is no more."""
    d, c = desired.select("key", "member", F.lit(1).alias("d")), current.select("key", "member", F.lit(1).alias("c"))
    both = d.join(c, ["key", "member"], "full")
    action = F.when(F.col("c").isNull(), "upsert").when(F.col("d").isNull(), "delete")
    return both.select("key", "member", action.alias("action")).where("action IS NOT NULL")


def acknowledgement(placed: DataFrame, required: int = 0) -> DataFrame:
    """Adds acks: `full`, or `partial` where fewer members than required hold a copy; 0 requires those there are."""
    there = F.size("members")
    return placed.withColumn("acks", F.when(there >= (F.lit(required) if required > 0 else there), "full").otherwise("partial"))


def first_members(members: DataFrame) -> DataFrame:
    """One row for each member id, the first to register, in id order."""
    first = Window.partitionBy("id").orderBy("registered")
    return members.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").orderBy("id")
