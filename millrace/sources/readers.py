"""Sources: text, resources, tab-separated pairs, sequence files, Avro, Parquet and rows in memory."""

from __future__ import annotations

import importlib.resources
import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_tab
from ..operators.collection import Collection, Table
from ..types import checked, collection_of, to_avro
from .avro import AvroSource
from .seqfile import SequenceSource


def text_file(spark: SparkSession, path: str) -> Collection:
    """One element a line, UTF-8. Directories and patterns serve as well."""
    return Collection(spark.read.text(path).select("value"))


def text_with_origin(spark: SparkSession, *paths: str) -> Table:
    """Lines of several inputs in one scan, keyed by the file that they come from."""
    lines = spark.read.text(list(paths))
    return Table(lines.select(F.col("_metadata.file_path").alias("key"), "value"))


def resource_file(spark: SparkSession, package: str, name: str) -> Collection:
    """Lines of a text file that is part of a Python package; they end with \\n, \\r or both, and with nothing else."""
    raw = importlib.resources.files(package).joinpath(name).read_bytes().decode("utf-8")
    return from_rows(spark, lines_of(raw), T.StringType())


def lines_of(text: str) -> list[str]:
    lines = re.split(r"\r\n|\n|\r", text)
    return lines if lines[-1] else lines[:-1]


def tab_pairs(spark: SparkSession, path: str) -> Table:
    """Lines cut at the first tab; without a tab the line is the key and the value is empty."""
    k, v = first_tab(F.col("value"))
    return Table(spark.read.text(path).select(k.alias("key"), v.alias("value")))


def sequence_file(spark: SparkSession, path: str, schema: T.StructType) -> Table:
    """Pairs of Hadoop sequence files of standard Writables."""
    spark.dataSource.register(SequenceSource)
    return Table(spark.read.format("millrace_sequence").schema(schema).load(path))


def avro_file(spark: SparkSession, path: str, schema: T.DataType | dict | list | str | None = None):
    """A collection of the records or bare values of Avro files; with the columns key and value, a table.

    ``schema`` is a reader schema: a Spark type, or an Avro schema as Python objects. Each file is resolved to it by the
    rules of Avro: fields by name (or alias), missing ones by their default (null for a nullable Spark field), int to long,
    float or double, string to bytes and back. Without it the schema is that of the first file, to which others are resolved.
    """
    spark.dataSource.register(AvroSource)
    reader = spark.read.format("millrace_avro")
    if schema is not None:
        if isinstance(schema, T.DataType):
            record = isinstance(schema, T.StructType)
            schema = to_avro(schema, nullable=not record)
        reader = reader.option("reader", json.dumps(schema))
    return _bag(reader.load(path), None)


def parquet(spark: SparkSession, path: str, schema: T.DataType | None = None):
    return _bag(spark.read.parquet(path), schema)


def _bag(df: DataFrame, schema: T.DataType | None):
    if df.columns == ["key", "value"]:
        return Table(df, schema)
    if df.columns != ["value"]:
        df = df.select(F.struct(*df.columns).alias("value"))
    return Collection(df, schema)


def declared(spark: SparkSession, path: str, schema: T.StructType):
    """The format follows the declared type: lines for a collection of strings, tab-separated pairs for a table of
    strings, sequence files for other tables, Parquet for other collections."""
    string = T.StringType()
    if schema == collection_of(string):
        return text_file(spark, path)
    kinds = [f.dataType for f in schema.fields]
    if schema.fieldNames() == ["key", "value"]:
        return tab_pairs(spark, path) if kinds == [string, string] else sequence_file(spark, path, schema)
    return parquet(spark, path, schema)


def from_rows(spark: SparkSession, rows: Iterable, kind: T.DataType) -> Collection:
    """Elements in memory; a copy is taken."""
    schema = collection_of(kind)
    return Collection(checked(spark.createDataFrame([(r,) for r in rows], schema), schema))


def from_pairs(spark: SparkSession, pairs: Iterable[tuple], schema: T.StructType) -> Table:
    return Table(spark.createDataFrame(list(pairs), schema))
