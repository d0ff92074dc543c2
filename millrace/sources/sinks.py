"""Sinks. Each writes one bag to a folder; none overwrites what is there unless told to."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators.collection import Collection, Table
from .avro import AvroSource
from .seqfile import SequenceSource


def text(bag, path: str, mode: str = "errorifexists") -> None:
    """Lines of a collection, or key, tab and value of a table. Nulls are written as empty text.

    A line break in a text, or a tab in a key, would be read back as something else and fails the job.
    """

    def show(c: str, breaks: str):
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        no = F.raise_error(F.concat(F.lit(f"a {c} has a line break or a tab: "), text)).cast("string")
        return F.when(F.translate(text, breaks, "") == text, text).otherwise(no)

    line = F.concat_ws("\t", show("key", "\n\r\t"), show("value", "\n\r")) if isinstance(bag, Table) else show("value", "\n\r")
    bag.df.select(line.alias("value")).write.mode(mode).text(path)


def sequence_file(table: Table, path: str, mode: str = "append", nulls: bool = False) -> None:
    """Pairs as the Writables of their types. A null has none and fails the job, unless ``nulls`` asks for ObjectWritables."""
    spark = table.df.sparkSession
    spark.dataSource.register(SequenceSource)
    table.df.write.format("millrace_sequence").mode(mode).option("nulls", str(nulls).lower()).save(path)


def avro(bag, path: str, mode: str = "append", codec: str = "deflate", schema: dict | list | str | None = None) -> None:
    """Structs and tables as records, other collections as bare values; ``schema`` is an Avro schema to write (enums, fixed …)."""
    spark = bag.df.sparkSession
    spark.dataSource.register(AvroSource)
    df, bare = bag.df, False
    if isinstance(bag, Collection):
        if bag.schema["value"].dataType.typeName() == "struct":
            df = df.select("value.*")
        else:
            bare = True
    writer = df.write.format("millrace_avro").mode(mode).option("codec", codec).option("bare", str(bare).lower())
    if schema is not None:
        writer = writer.option("writer", json.dumps(schema))
    writer.save(path)


def parquet(bag, path: str, mode: str = "errorifexists") -> None:
    bag.df.write.mode(mode).parquet(path)
