"""Bags over streaming DataFrames.

Column functions and flatten work on a stream as they do on a batch. Combining needs a window and a watermark,
after which a window is final and its state is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.combiners import REGISTRY, Combiner
from ..operators.collection import Collection, Table


def text_stream(spark: SparkSession, path: str) -> Collection:
    """Lines of the files that arrive in a folder."""
    return Collection(spark.readStream.text(path).select("value"))


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_a_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return reader.parquet(path)


def windowed(events: DataFrame, time: str, key: Column, value: Column, combiner: Combiner | str, window: str, late: str) -> Table:
    """Combines the values of each key and window; rows later than ``late`` are left out."""
    if isinstance(combiner, str):
        combiner = REGISTRY[combiner]()
    parts = events.withWatermark(time, late).select(F.col(time).alias("_t"), key.alias("_k"), value.alias("_v"))
    out = parts.groupBy(F.window("_t", window).alias("w"), F.col("_k")).agg(combiner(F.col("_v")).alias("value"))
    return Table(out.select(F.struct(F.col("w.start").alias("start"), F.col("_k").alias("key")).alias("key"), "value"))


def running(table: Table, combiner: Combiner | str) -> Table:
    """Combines each key over all that has arrived (update or complete mode)."""
    return table.group_by_key().combine(combiner)


def to_memory(bag, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Runs a stream into a table in memory, until all that is there has been read."""
    writer = bag.df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return query
