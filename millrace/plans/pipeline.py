"""The entry point of a program: sources, sinks and flatten, bound to a session."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import collection as c
from ..sources import readers, sinks


class Pipeline:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read_text_file(self, path: str) -> c.Collection:
        return readers.text_file(self.spark, path)

    def read_resource_file(self, package: str, name: str) -> c.Collection:
        return readers.resource_file(self.spark, package, name)

    def read_avro_file(self, path: str, kind: T.DataType | None = None):
        return readers.avro_file(self.spark, path, kind)

    def read_tab_pairs(self, path: str) -> c.Table:
        return readers.tab_pairs(self.spark, path)

    def read_sequence_file(self, path: str, schema: T.StructType) -> c.Table:
        return readers.sequence_file(self.spark, path, schema)

    def read_parquet(self, path: str):
        return readers.parquet(self.spark, path)

    def read_file(self, path: str, schema: T.StructType):
        """The format follows the declared type."""
        return readers.declared(self.spark, path, schema)

    def from_rows(self, rows: Iterable, kind: T.DataType) -> c.Collection:
        return readers.from_rows(self.spark, rows, kind)

    def from_pairs(self, pairs: Iterable[tuple], schema: T.StructType) -> c.Table:
        return readers.from_pairs(self.spark, pairs, schema)

    def collection(self, df: DataFrame) -> c.Collection:
        """A DataFrame with one column, whatever its name."""
        return c.Collection(df.toDF("value"))

    def table(self, df: DataFrame) -> c.Table:
        """A DataFrame with two columns, whatever their names."""
        return c.Table(df.toDF("key", "value"))

    def flatten(self, *bags, schema: T.DataType | None = None):
        return c.flatten(*bags, schema=schema)

    def write_avro_file(self, path: str, bag) -> None:
        sinks.avro(bag, path)

    def write_text_file(self, path: str, bag) -> None:
        sinks.text(bag, path)

    def write_sequence_file(self, path: str, table: c.Table) -> None:
        sinks.sequence_file(table, path)
