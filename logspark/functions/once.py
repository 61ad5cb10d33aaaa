"""Columns that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once: Spark moves conditions and projections through other projections, and
    computes what they use again in each place, but moves none through a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))
