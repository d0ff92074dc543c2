"""Several groupings of one input in a single scan and a single shuffle.

``channels`` tags each (key, value) with the grouping that it belongs to, so one aggregate serves all of them.
Keys and values must cast to common types; where they don't, persist the parent and group it several times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.collection import Table


def channels(df: DataFrame, **pairs: tuple[Column, Column]) -> DataFrame:
    """(channel, key, value): one row for each row and grouping."""
    each = [F.struct(F.lit(n).alias("channel"), k.cast("string").alias("key"), v.alias("value")) for n, (k, v) in pairs.items()]
    return df.select(F.inline(F.array(*each)))


def combined(df: DataFrame, combiner: Callable[[Column], Column], **pairs: tuple[Column, Column]) -> DataFrame:
    """All groupings combined by one partial and one final aggregate."""
    return channels(df, **pairs).groupBy("channel", "key").agg(combiner(F.col("value")).alias("value"))


def channel(tagged: DataFrame, name: str) -> Table:
    return Table(tagged.where(F.col("channel") == name).select("key", "value"))
