"""Guarded number parsing: anything that is not a plain finite number is NULL.

The value is read as text first and only then cast, so a JSON ``true`` never
becomes 1.0, an array or object (rendered as ``[..]`` / ``{..}``) fails the
pattern, and engine-specific spellings such as ``'1d'``, ``'inf'`` or ``'NaN'``
are refused before they can poison a sum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bridgelens.config import NUMBER_PATTERN

_INF = float("inf")


def safe_number(text: Column) -> Column:
    """Text -> DOUBLE, or NULL for non-numeric, non-finite or missing input."""
    return F.when(text.rlike(NUMBER_PATTERN), finite(text.try_cast("double")))


def finite(x: Column) -> Column:
    """``x``, or NULL where it is infinite or not a number."""
    return F.when(F.abs(x) < F.lit(_INF), x)


def safe_product(a: Column, b: Column) -> Column:
    """Product of two guarded numbers; NULL when either side is NULL or the product overflows."""
    return finite(a * b)
