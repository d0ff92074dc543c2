"""Column functions on text that pipelines use most."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_keep_empty(text: Column, pattern: str = r"\s") -> Column:
    """Parts between single separators; empty parts stay."""
    return F.split(text, pattern)


def split_words(text: Column) -> Column:
    """Words between runs of white space; no empty parts."""
    return F.array_remove(F.split(text, r"\s+"), "")


def field(text: Column, position: int, separator: str = "\t") -> Column:
    """The part at ``position`` (from 0), null where there are fewer."""
    return F.get(F.split(text, separator), position)


def first_tab(text: Column) -> tuple[Column, Column]:
    """Key and value around the first tab; without a tab the whole text is the key and the value is empty."""
    at = F.locate("\t", text)
    key = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    value = F.when(at > 0, F.substring(text, at + 1, F.char_length(text))).otherwise(F.lit(""))
    return key, value


def characters(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def solid_length(text: Column) -> Column:
    """Characters that are no white space."""
    return F.char_length(F.regexp_replace(text, r"\s", ""))


def stamped(date: Column, pattern: str = "yyyy/MM/dd") -> Column:
    """A date as text. The date is an argument, so that a run can be repeated."""
    return F.date_format(date, pattern)
