"""Ready-made combiners: associative folds that Catalyst runs with a partial phase before the shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Combiner:
    """``build`` turns the value column into an aggregate column."""

    name: str
    build: Callable[[Column], Column]

    def __call__(self, value: Column) -> Column:
        return self.build(value)


def total() -> Combiner:
    return Combiner("total", F.sum)


def count() -> Combiner:
    """Values of each key, nulls included."""
    return Combiner("count", lambda v: F.count(F.lit(1)))


def smallest() -> Combiner:
    return Combiner("smallest", F.min)


def largest() -> Combiner:
    return Combiner("largest", F.max)


def mean() -> Combiner:
    return Combiner("mean", F.avg)


def any_true() -> Combiner:
    return Combiner("any_true", F.bool_or)


def all_true() -> Combiner:
    return Combiner("all_true", F.bool_and)


def constant(value: object) -> Combiner:
    """The same value for every key, even for one with a single element."""
    return Combiner("constant", lambda v: F.first(F.lit(value)))


def first_by(*order: Column | str) -> Combiner:
    """The value that comes first in ``order`` (give a unique order for a stable result)."""
    return Combiner("first_by", lambda v: F.min_by(v, F.struct(*order)))


def last_by(*order: Column | str) -> Combiner:
    return Combiner("last_by", lambda v: F.max_by(v, F.struct(*order)))


def distinct_count() -> Combiner:
    return Combiner("distinct_count", F.count_distinct)


def approx_distinct_count(error: float = 0.05) -> Combiner:
    return Combiner("approx_distinct_count", lambda v: F.approx_count_distinct(v, error))


def joined_text(separator: str) -> Combiner:
    """The values as text in sorted order, with ``separator`` between them. The group must fit one row."""
    return Combiner("joined_text", lambda v: F.array_join(F.array_sort(F.collect_list(v.cast("string"))), separator))


#: combiners by name, for ``combine("total")``
REGISTRY: dict[str, Callable[[], Combiner]] = {
    f.__name__: f for f in (total, count, smallest, largest, mean, any_true, all_true, distinct_count, approx_distinct_count)
}
