"""Calendar buckets for the time series (whole days, no time zone involved)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bridgelens.config import TIME_UNITS


def check_unit(unit: str) -> str:
    u = str(unit).lower()
    if u not in TIME_UNITS:
        raise ValueError(f"unit must be one of {TIME_UNITS}, got {unit!r}")
    return u


def bucket(day: Column, unit: str) -> Column:
    """First day of the month / ISO week (Monday) / the day itself, as DATE."""
    u = check_unit(unit)
    return day if u == "day" else F.trunc(day, u)
