"""The canonical event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAP = T.MapType(T.StringType(), T.StringType(), True)

#: `ts_ns` is exact; `ts` has microseconds and is there for pruning. `ingest_seq` is the order of arrival. `tier` is
#: 0 for stored events and 1 for those that only the newest batch holds.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("ingest_seq", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("stream_labels", _MAP),
        T.StructField("body", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("resource_attrs", _MAP),
        T.StructField("log_attrs", _MAP),
        T.StructField("parsed_fields", _MAP),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("tier", T.ByteType()),
    ]
)


def empty_map():
    return F.create_map().cast(_MAP)


def canonical(df: DataFrame, *more: str) -> DataFrame:
    """Any table with some of the columns -> all of them in order, and those of `more`: missing and null texts are
    empty, missing and null maps have no keys, `ts_ns` comes from `ts` and `ts` from `ts_ns` where only one is there."""
    have = set(df.columns)
    made = {}
    for f in EVENT_SCHEMA:
        if f.name == "ts" and "ts_ns" in have:
            made_up = F.timestamp_micros(F.floor(F.col("ts_ns") / 1000)).cast("timestamp_ntz")
            column = F.coalesce("ts", made_up) if "ts" in have else made_up
        elif f.name == "ts_ns" and "ts" in have:
            made_up = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
            column = F.coalesce("ts_ns", made_up) if "ts_ns" in have else made_up
        elif f.name not in have:
            column = empty_map() if f.dataType == _MAP else F.lit({"ingest_seq": 0, "tier": 0}.get(f.name, ""))
        elif f.dataType == _MAP:
            column = F.coalesce(F.col(f.name).cast(_MAP), empty_map())
        elif f.dataType == T.StringType():
            column = F.coalesce(F.col(f.name), F.lit(""))
        else:
            column = F.col(f.name)
        made[f.name] = column.cast(f.dataType)
    return df.select(*[c.alias(n) for n, c in made.items()], *more)
