"""Collections and key/value tables over DataFrames.

``Collection`` wraps a DataFrame with one logical column ``value``, ``Table`` one with ``key`` and ``value``.
Both are immutable bags: duplicates count, order means nothing. Functions come in explicit tiers:

* column functions (``map``, ``flat_map``, ``filter``, ``key_by`` …) take and return Columns, so Catalyst sees,
  fuses and pushes them down;
* ``parallel_do`` takes an arbitrary Python function from one element to any number of elements and runs it
  over Arrow batches.

Nothing runs before ``collect``, iteration, a write or ``Workflow.run``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import checked, collection_of
from .python_tier import emitted

KEY, VALUE = "key", "value"


class _Bag:
    columns: tuple[str, ...]

    def __init__(self, df: DataFrame, schema: T.DataType | None = None, parents: tuple = (), opaque: bool = False):
        if tuple(df.columns) != self.columns:
            raise ValueError(f"expected the columns {self.columns}, got {tuple(df.columns)}")
        self.df = checked(df, schema)
        self.parents = parents
        #: whether computing it again is expensive (Python functions, shuffles)
        self.opaque = opaque

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def _like(self, df: DataFrame, opaque: bool = False):
        return type(self)(df, parents=(self,), opaque=opaque)

    def distinct(self):
        return self._like(self.df.distinct(), True)

    def persist(self):
        self.df.persist()
        return self

    def collect(self) -> list:
        """All elements on the driver: for small results and tests."""
        return [self._element(r) for r in self.df.collect()]

    def __iter__(self) -> Iterator:
        """Elements one after the other, with one partition on the driver at a time."""
        return (self._element(r) for r in self.df.toLocalIterator())

    def flatten(self, *others):
        """Bag union with others of the same kind; duplicates stay."""
        return flatten(self, *others)

    def _do(self, fn: Callable, schema: T.StructType, table: bool) -> DataFrame:
        return emitted(self.df, self.columns, fn, schema, table)


def _exploded(df: DataFrame, arrays: Column, name: str) -> DataFrame:
    return df.select(F.explode(arrays).alias(name))


class Collection(_Bag):
    """A bag of elements in the column ``value``."""

    columns = (VALUE,)

    @staticmethod
    def _element(row):
        return row[VALUE]

    def map(self, fn: Callable[[Column], Column], schema: T.DataType | None = None) -> Collection:
        """One element to one element."""
        return Collection(self.df.select(fn(F.col(VALUE)).alias(VALUE)), schema, (self,))

    def flat_map(self, fn: Callable[[Column], Column], schema: T.DataType | None = None) -> Collection:
        """One element to the elements of an array column."""
        return Collection(_exploded(self.df, fn(F.col(VALUE)), VALUE), schema, (self,))

    def filter(self, fn: Callable[[Column], Column]) -> Collection:
        return Collection(self.df.where(fn(F.col(VALUE))), None, (self,))

    def map_pairs(self, fn: Callable[[Column], tuple[Column, Column]], schema: T.StructType | None = None) -> Table:
        """One element to one pair."""
        k, v = fn(F.col(VALUE))
        return Table(self.df.select(k.alias(KEY), v.alias(VALUE)), schema, (self,))

    def key_by(self, fn: Callable[[Column], Column]) -> Table:
        return self.map_pairs(lambda v: (fn(v), v))

    def flat_map_pairs(self, fn: Callable[[Column], list[tuple[Column, Column]]], schema: T.StructType | None = None) -> Table:
        """One element to a fixed list of pairs."""
        pairs = [F.struct(k.alias(KEY), v.alias(VALUE)) for k, v in fn(F.col(VALUE))]
        return Table(self.df.select(F.inline(F.array(*pairs))), schema, (self,))

    def parallel_do(self, fn: Callable[[object], Iterable], schema: T.DataType) -> Collection:
        """Python tier: ``fn(element)`` yields elements of type ``schema``."""
        return Collection(self._do(fn, collection_of(schema), False), None, (self,), True)

    def parallel_do_pairs(self, fn: Callable[[object], Iterable[tuple]], schema: T.StructType) -> Table:
        """Python tier: ``fn(element)`` yields (key, value)."""
        return Table(self._do(fn, schema, True), None, (self,), True)

    def count(self) -> Table:
        """How often each distinct element occurs (64-bit), nulls included."""
        out = self.df.groupBy(VALUE).agg(F.count(F.lit(1)).alias("n"))
        return Table(out.select(F.col(VALUE).alias(KEY), F.col("n").alias(VALUE)), None, (self,), True)

    def append(self, rows: Iterable) -> Collection:
        """A new collection with ``rows`` besides."""
        more = self.df.sparkSession.createDataFrame([(r,) for r in rows], self.schema)
        return Collection(self.df.unionAll(more), None, (self,))


class Table(_Bag):
    """A bag of pairs in the columns ``key`` and ``value``: keys may repeat, and so may pairs."""

    columns = (KEY, VALUE)

    @staticmethod
    def _element(row):
        return (row[KEY], row[VALUE])

    def map(self, fn: Callable[[Column, Column], Column], schema: T.DataType | None = None) -> Collection:
        """One pair to one element."""
        return Collection(self.df.select(fn(F.col(KEY), F.col(VALUE)).alias(VALUE)), schema, (self,))

    def flat_map(self, fn: Callable[[Column, Column], Column], schema: T.DataType | None = None) -> Collection:
        return Collection(_exploded(self.df, fn(F.col(KEY), F.col(VALUE)), VALUE), schema, (self,))

    def map_pairs(self, fn: Callable[[Column, Column], tuple[Column, Column]], schema: T.StructType | None = None) -> Table:
        """One pair to one pair: re-key, change values, swap."""
        k, v = fn(F.col(KEY), F.col(VALUE))
        return Table(self.df.select(k.alias(KEY), v.alias(VALUE)), schema, (self,))

    def flat_map_pairs(self, fn: Callable[[Column, Column], list[tuple[Column, Column]]], schema: T.StructType | None = None) -> Table:
        pairs = [F.struct(k.alias(KEY), v.alias(VALUE)) for k, v in fn(F.col(KEY), F.col(VALUE))]
        return Table(self.df.select(F.inline(F.array(*pairs))), schema, (self,))

    def filter(self, fn: Callable[[Column, Column], Column]) -> Table:
        return self._like(self.df.where(fn(F.col(KEY), F.col(VALUE))))

    def parallel_do(self, fn: Callable[[object, object], Iterable], schema: T.DataType) -> Collection:
        """Python tier: ``fn(key, value)`` yields elements."""
        return Collection(self._do(fn, collection_of(schema), False), None, (self,), True)

    def parallel_do_pairs(self, fn: Callable[[object, object], Iterable[tuple]], schema: T.StructType) -> Table:
        """Python tier: ``fn(key, value)`` yields (key, value)."""
        return Table(self._do(fn, schema, True), None, (self,), True)

    def keys(self) -> Collection:
        return self.map(lambda k, v: k)

    def values(self) -> Collection:
        return self.map(lambda k, v: v)

    def pairs(self) -> Collection:
        """The same bag as a collection of structs."""
        return self.map(lambda k, v: F.struct(k.alias(KEY), v.alias(VALUE)))

    def count(self) -> Table:
        """How often each distinct pair occurs; keys of the result are pairs."""
        return self.pairs().count()

    def group_by_key(self):
        """A deferred grouping; how it is used decides the plan."""
        from .grouped import Grouped

        return Grouped(self)

    def join(self, other: Table):
        """A deferred co-group with ``other``: every key of either side once; null keys meet null keys."""
        from .joined import CoGrouped

        return CoGrouped(self, other)


def flatten(*bags, schema: T.DataType | None = None):
    """Bag union of collections, or of tables (the result is then a table)."""
    if not bags:
        raise ValueError("nothing to flatten")
    kind = type(bags[0])
    if any(type(b) is not kind for b in bags):
        raise TypeError("collections and tables cannot be mixed")
    if len(bags) == 1:
        return kind(bags[0].df, schema, bags)
    for b in bags[1:]:
        if [t for _, t in b.df.dtypes] != [t for _, t in bags[0].df.dtypes]:
            raise TypeError(f"{bags[0].df.dtypes} and {b.df.dtypes} differ")
    return kind(reduce(DataFrame.unionByName, (b.df for b in bags)), schema, bags)
