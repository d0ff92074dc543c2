"""Grouping by key. The handle is deferred: combining never gathers a group, asking for its values does."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.combiners import REGISTRY, Combiner
from .collection import KEY, VALUE, Table
from .python_tier import batches_of, by_name, folded_in_task, framed, pairs_in, streamed


def _ordering(order: Iterable[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


class Grouped:
    """Values by key of a table. Null keys form a group; NaN keys form one; 0.0 and -0.0 are one key."""

    def __init__(self, table: Table):
        self.table = table
        self.df = table.df

    def _table(self, df: DataFrame, schema=None) -> Table:
        return Table(df, schema, (self.table,), True)

    def values(self) -> Table:
        """One row a key with all its values as an array, nulls and duplicates included.

        A group must fit one row: for large groups use ``combine``, ``sorted_rows`` or ``top``.
        """
        kept = F.collect_list(F.struct(VALUE))
        return self._table(self.df.groupBy(KEY).agg(F.transform(kept, lambda x: x[VALUE]).alias(VALUE)))

    def sorted_values(self, *order: Column | str) -> Table:
        """Like ``values``, in the order of ``order`` (of the values themselves if none is given), ascending."""
        by = _ordering(order) or [F.col(VALUE)]
        kept = F.array_sort(F.collect_list(F.struct(*(c.alias(f"_{i}") for i, c in enumerate(by)), F.struct(VALUE).alias("_v"))))
        return self._table(self.df.groupBy(KEY).agg(F.transform(kept, lambda x: x["_v"][VALUE]).alias(VALUE)))

    def sorted_rows(self, *order: Column | str, global_order: bool = False) -> Table:
        """The pairs, those of a key together and in order; groups may be of any size (sorting spills).

        With ``global_order`` keys ascend over all partitions, else within each.
        """
        by = [F.col(KEY), *_ordering(order)]
        df = self.df.orderBy(*by) if global_order else self.df.repartition(KEY).sortWithinPartitions(*by)
        return self._table(df)

    def top(self, n: int, *order: Column | str) -> Table:
        """The first ``n`` pairs of each key in ``order``; ranks are limited before the shuffle."""
        w = Window.partitionBy(KEY).orderBy(*_ordering(order))
        return self._table(self.df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r"))

    def first(self, *order: Column | str) -> Table:
        return self._aggregated(F.min_by(VALUE, F.struct(*_ordering(order))))

    def last(self, *order: Column | str) -> Table:
        return self._aggregated(F.max_by(VALUE, F.struct(*_ordering(order))))

    def keys(self):
        """The distinct keys."""
        return self.table.keys().distinct()

    def _aggregated(self, column: Column, schema=None) -> Table:
        return self._table(self.df.groupBy(KEY).agg(column.alias(VALUE)), schema)

    def combine(self, combiner: Combiner | str | Callable[[Iterable], object], schema: T.DataType | None = None) -> Table:
        """Folds the values of each key with an associative function.

        A ``Combiner`` (or its name) becomes a Catalyst aggregate with a partial phase. A Python function from
        a list of values to one value of the same type is folded in two phases over Arrow batches: within
        each task, some thousand values at a time, then over the partial results of a key. It is called at least once for
        every key.
        """
        if isinstance(combiner, str):
            combiner = REGISTRY[combiner]()
        if isinstance(combiner, Combiner):
            return self._aggregated(combiner(F.col(VALUE)), schema)
        return self._folded(combiner)

    def aggregate(self, **columns: Column) -> Table:
        """Several aggregates at once; the value is a struct."""
        return self._aggregated(F.struct(*(c.alias(n) for n, c in columns.items())))

    def fold(self, initial: Column, merge: Callable[[Column, Column], Column]) -> Table:
        """A fold by Column functions over the gathered values (a group must fit one row); order is not defined."""
        kept = F.collect_list(F.struct(VALUE))
        return self._aggregated(F.aggregate(kept, initial, lambda acc, x: merge(acc, x[VALUE])))

    def _folded(self, fn: Callable[[Iterable], object]) -> Table:
        schema = self.df.schema
        arrow, named = to_arrow_schema(schema), by_name(schema)
        partial = lambda batches: batches_of(folded_in_task(fn, pairs_in(batches), named), arrow)
        return self._table(streamed(self.df, lambda k, values: [(k, fn(list(values)))], schema, partial, schema))

    def reduce(self, fn: Callable[[object, Iterable], Iterable[tuple]], schema: T.StructType) -> Table:
        """Python tier: all pairs that ``fn(key, values)`` yields; ``values`` is an iterator, so groups may be of any size."""
        return self._table(streamed(self.df, fn, schema))

    def apply(self, fn: Callable, schema: T.StructType) -> Table:
        """Python tier: ``fn(pandas frame of one key)`` returns a frame of keys and values. A group must fit memory."""
        return self._table(framed(self.df, fn, schema))
