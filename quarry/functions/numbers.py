"""Exact and typed numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(col: str | Column) -> Column:
    """A double as a decimal of two places: sums of it do not depend on their order."""
    return (F.col(col) if isinstance(col, str) else col).cast("decimal(18,2)")


def clamp(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))
