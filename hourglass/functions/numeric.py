"""Numeric column helpers: NaN handling, clipping, float casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN and NULL differ in Spark (avg over a NaN is NaN); fold NaN into NULL."""
    return F.nanvl(_c(c), F.lit(None).cast("double"))


def is_finite(c: str | Column) -> Column:
    """True for a value that is neither NULL nor NaN; infinite values pass, as in the surveyed mask."""
    x = _c(c)
    return x.isNotNull() & ~F.isnan(x)


def clip_floor(c: str | Column, lo: float = 0.0) -> Column:
    """``max(c, lo)`` that keeps NULL as NULL (``greatest`` would turn NULL into ``lo``)."""
    x = _c(c)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(lo)))


def as_float(c: str | Column) -> Column:
    """Model inputs are single precision in the reference."""
    return _c(c).cast("float")
