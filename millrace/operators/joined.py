"""Co-group of two tables and the joins that derive from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .collection import KEY, VALUE, Table


class CoGrouped:
    """Every key of either table once, with the values of both. Null keys meet null keys.

    The flat joins plan a join of the rows and never gather a group.
    """

    def __init__(self, left: Table, right: Table):
        if left.schema[KEY].dataType != right.schema[KEY].dataType:
            raise TypeError("the keys have different types")
        self.left, self.right = left, right

    def _table(self, df: DataFrame) -> Table:
        return Table(df, None, (self.left, self.right), True)

    def _tagged(self) -> DataFrame:
        """Both sides in one bag, so that one shuffle brings them together."""
        none = F.lit(None)
        a = self.left.df.select(KEY, F.struct(VALUE).alias("left"), none.cast(self._struct(self.right)).alias("right"))
        b = self.right.df.select(KEY, none.cast(self._struct(self.left)).alias("left"), F.struct(VALUE).alias("right"))
        return a.unionByName(b)

    @staticmethod
    def _struct(table: Table) -> T.StructType:
        return T.StructType([T.StructField(VALUE, table.schema[VALUE].dataType)])

    def values(self) -> Table:
        """key, struct<left: array, right: array>; the array of a missing side is empty. Nulls and duplicates stay."""
        both = self._tagged().groupBy(KEY).agg(F.collect_list("left").alias("left"), F.collect_list("right").alias("right"))
        side = lambda c: F.transform(c, lambda x: x[VALUE]).alias(c)
        return self._table(both.select(KEY, F.struct(side("left"), side("right")).alias(VALUE)))

    def sizes(self) -> Table:
        """key, struct<left, right>: numbers of values, with partial counts before the shuffle."""
        both = self._tagged().groupBy(KEY).agg(F.struct(F.count("left").alias("left"), F.count("right").alias("right")).alias(VALUE))
        return self._table(both)

    def _joined(self, how: str) -> DataFrame:
        a = self.left.df.select(F.col(KEY).alias("_a"), F.col(VALUE).alias("left"))
        b = self.right.df.select(F.col(KEY).alias("_b"), F.col(VALUE).alias("right"))
        return a.join(b, F.col("_a").eqNullSafe(F.col("_b")), how)

    def _flat(self, how: str) -> Table:
        df = self._joined(how)
        key = F.coalesce("_a", "_b")
        return self._table(df.select(key.alias(KEY), F.struct("left", "right").alias(VALUE)))

    def inner(self) -> Table:
        return self._flat("inner")

    def left_outer(self) -> Table:
        return self._flat("left")

    def right_outer(self) -> Table:
        return self._flat("right")

    def full_outer(self) -> Table:
        return self._flat("full")

    def semi(self) -> Table:
        """Pairs of the left table whose key the right one has."""
        return self._table(self._joined("left_semi").select(F.col("_a").alias(KEY), F.col("left").alias(VALUE)))

    def anti(self) -> Table:
        """Pairs of the left table whose key the right one lacks."""
        return self._table(self._joined("left_anti").select(F.col("_a").alias(KEY), F.col("left").alias(VALUE)))

    def apply(self, fn: Callable, schema: T.StructType) -> Table:
        """Python tier: ``fn(left frame, right frame)`` for each key. A group must fit memory."""
        grouped = self.left.df.groupBy(KEY).cogroup(self.right.df.groupBy(KEY))
        return self._table(grouped.applyInPandas(fn, schema))
