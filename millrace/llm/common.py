"""What the operators of this folder share: reading tables, shared scratch space, Arrow mapping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch

#: lower-cases A-Z and turns every byte that is in no alphanumeric word into a space
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Scopes(threading.local):
    def __init__(self):
        self.open: list[list[DataFrame]] = []


_scopes = _Scopes()


@contextlib.contextmanager
def tidied():
    """Tables that are ``saved`` inside are deleted at the end, but for those saved with ``keep``.

    A result that is read later has to be saved with ``keep``; an enclosing scope then owns it.
    """
    _scopes.open.append([])
    try:
        yield
    finally:
        discard(*_scopes.open.pop())


def saved(df: DataFrame, name: str = "step", keep: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    owner = len(_scopes.open) - (2 if keep else 1)
    if owner >= 0:
        _scopes.open[owner].append(out)
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Deletes what ``saved`` has written, with the folder of the table's own that it lies in."""
    for df in frames:
        path = getattr(df, "_millrace_path", None)
        if path:
            remove(df.sparkSession, path.rpartition("/")[0])


@contextlib.contextmanager
def given_back():
    """After a task, memory that its Python worker no longer needs goes back to the system; workers are kept and reused."""
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


#: bytes of input that are Python objects at once, about
SLICE = 8 << 20


def pieces(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and of about ``SLICE`` bytes; a row is never cut."""
    step = max(1, min(rows, batch.num_rows * SLICE // max(1, batch.nbytes)))
    return (batch.slice(k, step) for k in range(0, batch.num_rows, step))


def map_columns(
    df: DataFrame,
    columns: Sequence[str | Column],
    schema: str,
    start: Callable[[], Callable[..., list]],
    rows: int = 1000,
) -> DataFrame:
    """Narrow, streaming Arrow map.

    ``start()`` runs once for each task and returns a function that takes columns as lists and returns the
    output columns. It gets ``rows`` rows at a time, fewer where they are long, and only one input batch is held.
    """
    picked = df.select(*columns)
    fields = picked.limit(0).sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with given_back():
            work = start()
            for part in (part for b in batches for part in pieces(b, rows)):
                out = work(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(out, arrow)],
                    schema=arrow,
                )
            del work

    return picked.mapInArrow(run, fields)


def with_columns(df: DataFrame, column: str, added: str, start: Callable[[], Callable[[list], list]], rows: int = 500) -> DataFrame:
    """``df`` with the columns of ``added`` (a schema) that ``start()(values of column)`` gives, as Arrow arrays.

    Output goes out in pieces of ``rows`` rows, so neither side holds the results of a whole input batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = df.sparkSession.createDataFrame([], added).schema
    taken = {f.name.lower() for f in new.fields}
    kept = df.select(*(c for c in df.columns if c.lower() not in taken))
    at = kept.columns.index(column)
    schema = StructType([*kept.schema.fields, *new.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with given_back():
            work = start()
            for part in (part for b in batches for part in pieces(b, rows)):
                out = [*part.columns, *work(part.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(out, arrow)], schema=arrow)
            del work

    return kept.mapInArrow(run, schema)


def bucket(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: rows of keys that are broadcast at most
BROADCAST_KEYS = 1_000_000


def keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, th): what names a document whose id may be missing or repeated; th is a hash of its text."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))


def _keys(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``keys`` ready to be joined (a broadcast if their number, which is counted, allows it), and the condition."""
    keys = saved(keys.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "keys")
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return F.broadcast(keys) if small else keys, keys


def without(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose (doc_id, th) is not in ``keys``: a broadcast of checked size, else a shuffled join."""
    side, keys = _keys(keys)
    same = documents["doc_id"].cast("long").eqNullSafe(keys["_id"]) & (F.xxhash64(documents["text"]) == keys["_th"])
    return documents.join(side, same, "left_anti")


def only(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of (doc_id, th, …) whose (doc_id, th) is in ``keys``, planned like ``without``."""
    side, keys = _keys(keys)
    same = documents["doc_id"].eqNullSafe(keys["_id"]) & (documents["th"] == keys["_th"])
    return documents.join(side, same, "left_semi")
