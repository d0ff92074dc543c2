"""Python functions over Arrow batches: elements, folds within a task, and whole groups as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: rows that leave a task in one piece
PIECE = 10_000
#: keys that a task of a fold holds before it hands its partial results on
HELD_KEYS = 100_000
#: values of a key that go to its group as one row at most, and their bytes, about
PACKED, PACKED_BYTES = 256, 4096
#: frames of groups that leave a task in one piece
FRAMES = 1000


def batches_of(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about PIECE rows, however many there are."""
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= PIECE:
            yield out()
            held = []
    if held:
        yield out()


def same_key(a, b) -> bool:
    """Whether two keys are one group: nulls, NaN and both zeros are equal to themselves."""
    return a == b or hashable(a) == hashable(b)


def hashable(key):
    if isinstance(key, dict):
        return tuple((n, hashable(x)) for n, x in key.items())
    if isinstance(key, list):
        return tuple(map(hashable, key))
    return "nan" if key != key else key


def pairs_in(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch["key"].to_pylist(), batch["value"].to_pylist())


def codes(keys: pa.Array) -> pa.Array:
    """A number for each key; only keys of one group have the same."""
    if not pa.types.is_nested(keys.type):
        return keys.dictionary_encode(null_encoding="encode").indices
    seen: dict = {}
    return pa.array([seen.setdefault(hashable(k), len(seen)) for k in keys.to_pylist()], type=pa.int32())


def packed(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The pairs of each batch as rows of a key and a list of values of it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        most = max(1, min(PACKED, PACKED_BYTES * batch.num_rows // max(1, batch.nbytes)))
        of = codes(batch["key"])
        order = pc.sort_indices(of)
        starts: list[int] = []
        at = 0
        for end in pc.run_end_encode(of.take(order)).run_ends.to_pylist():
            starts.extend(range(at, end, most))
            at = end
        keys, values = (batch[c].take(order) for c in ("key", "value"))
        kept, listed = schema.field("key").type, schema.field("value").type
        lists = pa.ListArray.from_arrays(pa.array([*starts, at], type=pa.int32()), values.cast(listed.value_type), type=listed)
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(starts, type=pa.int32())).cast(kept), lists], schema=schema)


def lists_in(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, list of values) of packed pairs; some thousand values are Python objects at once."""
    step = PIECE // PACKED
    for batch in batches:
        for part in (batch.slice(k, step) for k in range(0, batch.num_rows, step)):
            values, at = part["value"].flatten().to_pylist(), 0
            for key, n in zip(part["key"].to_pylist(), part["value"].value_lengths().to_pylist()):
                yield key, values[at : at + n]
                at += n


def emitting(columns: tuple[str, ...], fn: Callable[..., Iterable], schema: T.StructType, pairs: bool) -> Callable:
    """A function from the batches of a task to batches of all that ``fn`` yields."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        def rows():
            for batch in batches:
                for args in zip(*(batch[c].to_pylist() for c in columns)):
                    yield from fn(*args) if pairs else ((x,) for x in fn(*args))

        return batches_of(rows(), arrow)

    return run


def emitted(df: DataFrame, columns: tuple[str, ...], fn: Callable[..., Iterable], schema: T.StructType, pairs: bool) -> DataFrame:
    """All that ``fn`` yields for the elements of ``df``: pairs, or single values."""
    return df.mapInArrow(emitting(columns, fn, schema, pairs), schema)


def folded_in_task(fn: Callable[[Iterable], object], pairs: Iterable[tuple], by_name: bool) -> Iterator[tuple]:
    """(key, fold) of the pairs; values of a key are gathered and folded some thousand at a time."""
    held: dict = {}
    waiting = 0
    for k, v in pairs:
        name = hashable(k) if by_name else k
        if name in held:
            held[name][1].append(v)
        else:
            held[name] = (k, [v])
        waiting += 1
        if waiting >= PIECE:
            for key, values in held.values():
                if len(values) > 1:
                    values[:] = [fn(values)]
            waiting = 0
            if len(held) >= HELD_KEYS:
                yield from ((key, fn(values)) for key, values in held.values())
                held = {}
    yield from ((key, fn(values)) for key, values in held.values())


def by_name(schema: T.StructType) -> bool:
    """Whether keys of this type need ``hashable``."""
    return isinstance(schema["key"].dataType, (T.StructType, T.ArrayType, T.MapType, T.FloatType, T.DoubleType))


def streamed(df: DataFrame, fn: Callable[[object, Iterator], Iterable[tuple]], schema: T.StructType, before: Callable | None = None, kind: T.StructType | None = None) -> DataFrame:
    """All that ``fn(key, values)`` yields for each group of (key, value).

    Groups are sorted together and read one after the other: ``values`` is an iterator over the group, so a group of any
    size passes through a task in bounded memory. What ``fn`` leaves unread is skipped. Values of a key that lie in one batch
    are shuffled and sorted as lists, so that a frequent key costs the sort little more than its values.

    ``before`` maps the batches of a task to batches of pairs of type ``kind``, in the pass that makes the lists.
    """
    arrow = to_arrow_schema(schema)
    kind = df.schema if before is None else kind
    listed = T.StructType([T.StructField("key", kind["key"].dataType), T.StructField("value", T.ArrayType(kind["value"].dataType))])
    lists = to_arrow_schema(listed)

    def pack(batches):
        return packed(batches if before is None else before(batches), lists)

    def run(batches):
        pairs = lists_in(batches)
        ahead: list[tuple] = []

        def values(key):
            while ahead or (pair := next(pairs, None)) is not None:
                if ahead:
                    pair = ahead.pop()
                if not same_key(pair[0], key):
                    ahead.append(pair)
                    return
                yield from pair[1]

        def rows():
            while ahead or (pair := next(pairs, None)) is not None:
                if not ahead:
                    ahead.append(pair)
                key = ahead[0][0]
                group = values(key)
                yield from fn(key, group)
                for _ in group:
                    pass

        return batches_of(rows(), arrow)

    return df.mapInArrow(pack, listed).repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def framed(df: DataFrame, fn: Callable, schema: T.StructType) -> DataFrame:
    """The rows of all frames that ``fn(pandas frame of one key)`` returns.

    Groups are sorted together. Whole batches become frames, which are cut at the keys, and results leave many at a time.
    A group's frame is as if converted alone: integers and booleans, whose type in pandas depends on nulls, travel without
    them and beside a flag. A hash beside the key tells apart what is equal in pandas only (null and NaN, an hour twice).
    Nested keys and values, whose parts depend on nulls of their neighbours as well, are left to Spark, group by group,
    and so are streams, which cannot be sorted.
    """
    if df.isStreaming or any(isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) for f in df.schema.fields):
        return df.groupBy("key").applyInPandas(fn, schema)
    names = schema.fieldNames()
    filled = {f.name: isinstance(f.dataType, T.BooleanType) for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.BooleanType))}

    def sent(c: str) -> Column:
        return F.coalesce(c, F.lit(0).cast(df.schema[c].dataType)).alias(c) if c in filled else F.col(c)

    def pieces(frames):
        """The frames of each group, one of each batch, with the flags of those that have nulls."""
        last, held = None, []
        for frame in frames:
            keys = list(zip(frame["_hash"].tolist(), map(hashable, frame["key"].tolist())))
            nulls = {c: frame[f"_no_{c}"].to_numpy() for c in filled if frame[f"_no_{c}"].any()}
            frame = frame[["key", "value"]]
            cuts = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if held and keys[a] != last:
                    yield held
                    held = []
                last = keys[a]
                held.append((frame.iloc[a:b], {c: x[a:b] for c, x in nulls.items()}))
        if held:
            yield held

    def group(held):
        import pandas as pd

        out = pd.concat([x for x, _ in held], ignore_index=True) if len(held) > 1 else held[0][0].reset_index(drop=True)
        for c, boolean in filled.items():
            if any(c in nulls and nulls[c].any() for _, nulls in held):
                column = out[c].astype(object if boolean else "float64")
                column[[no for x, nulls in held for no in (nulls[c].tolist() if c in nulls else [False] * len(x))]] = None
                out[c] = column
        return out

    def named(out):
        import pandas as pd

        if not isinstance(out, pd.DataFrame):
            raise TypeError(f"a function of groups returned a {type(out).__name__}, not a pandas frame")
        columns = list(out.columns)
        if columns == names or (out.empty and not columns):
            return out
        strings = any(isinstance(c, str) for c in columns)
        if len(columns) != len(names) or (strings and set(columns) != set(names)):
            raise ValueError(f"a function of groups returned the columns {columns}, not {names}")
        return out[names] if strings else out.set_axis(names, axis=1)

    def run(frames):
        import pandas as pd

        held: dict[tuple, list] = {}
        n = rows = 0
        for part in pieces(x for x in frames if len(x)):
            out = named(fn(group(part)))
            if out.empty:
                continue
            held.setdefault(tuple(out.dtypes), []).append(out)
            n, rows = n + 1, rows + len(out)
            if n >= FRAMES or rows >= PIECE:
                yield from (pd.concat(x, ignore_index=True) for x in held.values())
                held, n, rows = {}, 0, 0
        yield from (pd.concat(x, ignore_index=True) for x in held.values())

    flags = [F.isnull(c).alias(f"_no_{c}") for c in filled]
    together = df.repartition("key").sortWithinPartitions("key")
    return together.select(sent("key"), sent("value"), F.xxhash64("key").alias("_hash"), *flags).mapInPandas(run, schema)
