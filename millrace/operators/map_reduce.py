"""A small map-reduce facade: flat map, optional combining, shuffle, optional reduce."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.combiners import Combiner
from .collection import KEY, VALUE, Table
from .python_tier import batches_of, by_name, emitting, folded_in_task, pairs_in, streamed


@dataclass(frozen=True)
class MapReduce:
    """Built step by step: ``MapReduce().map(f, schema).combine(g).reduce(h, schema).run(table)``.

    ``mapper(key, value)`` yields pairs. ``combiner(values)`` is an associative fold to one value; it is applied
    to any part of a key's values, once or more. ``reducer(key, values)`` yields pairs, whose keys may differ; ``values``
    is an iterator over the group (of one value after a combiner), so groups may be of any size.
    Without a reducer the mapped (and, with a combiner, combined) pairs are the result.

    A Python combiner runs in the same pass as the mapper before the shuffle, and in the same pass as the reducer behind it.
    """

    mapper: Callable[[object, object], Iterable[tuple]] | None = None
    map_schema: T.StructType | None = None
    combiner: object = None
    reducer: Callable[[object, Iterable], Iterable[tuple]] | None = None
    reduce_schema: T.StructType | None = None

    def map(self, mapper, schema: T.StructType) -> MapReduce:
        return replace(self, mapper=mapper, map_schema=schema)

    def combine(self, combiner) -> MapReduce:
        return replace(self, combiner=combiner)

    def reduce(self, reducer, schema: T.StructType) -> MapReduce:
        return replace(self, reducer=reducer, reduce_schema=schema)

    def run(self, table: Table) -> Table:
        mapper, fold, reducer = self.mapper, self.combiner, self.reducer
        if fold is not None and (isinstance(fold, (str, Combiner)) or not callable(fold)):
            if mapper is not None:
                table = table.parallel_do_pairs(mapper, self.map_schema)
            table, mapper, fold = table.group_by_key().combine(fold), None, None
        schema = self.map_schema if mapper is not None else table.schema
        if fold is not None:
            arrow, named = to_arrow_schema(schema), by_name(schema)

            def partial(batches):
                pairs = pairs_in(batches)
                if mapper is not None:
                    pairs = (out for pair in pairs for out in mapper(*pair))
                return batches_of(folded_in_task(fold, pairs, named), arrow)

            last = reducer or (lambda k, values: [(k, *values)])
            return Table(streamed(table.df, lambda k, values: last(k, iter([fold(list(values))])), self.reduce_schema if reducer else schema, partial, schema), None, (table,), True)
        if reducer is None:
            return table if mapper is None else table.parallel_do_pairs(mapper, schema)
        before = None if mapper is None else emitting((KEY, VALUE), mapper, schema, True)
        return Table(streamed(table.df, reducer, self.reduce_schema, before, schema), None, (table,), True)


__all__ = ["KEY", "VALUE", "MapReduce"]
