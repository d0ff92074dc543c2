"""Reading physical plans in tests."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> Counter:
    """Physical operators by name."""
    import re

    return Counter(m[1] for m in re.finditer(r"^[\s:|+\-*()\d]*([A-Z][A-Za-z]+)", plan_text(df), re.MULTILINE))
