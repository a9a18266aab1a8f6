"""Filters on columns that much was computed for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_where(rows: DataFrame, column: str, test: Callable[[Column], Column]) -> DataFrame:
    """The rows whose ``column`` passes. The optimizer does not look through a generator, so that the test stays
    behind the projections that made the column: pushed through them, it would take a copy of them along."""
    one = F.filter(F.array(F.struct(*rows.columns)), lambda r: test(r[column]))
    return rows.select(F.inline(one))
