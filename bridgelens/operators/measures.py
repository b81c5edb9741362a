"""Aggregate measures of the reports.

Distinct counts are exact by default: Spark plans them as a partial
de-duplication on (group, key) followed by a shuffle on that pair, so a hot
group is spread over the key space.  ``approx=True`` swaps in HyperLogLog++
(``approx_count_distinct``) for very large inputs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_ids(approx: bool = False) -> Column:
    return (F.approx_count_distinct("id") if approx else F.count_distinct("id")).alias("number_of_transfers")


def distinct_users(approx: bool = False) -> Column:
    return (F.approx_count_distinct("user") if approx else F.count_distinct("user")).alias("number_of_users")


def volume(name: str = "volume_usd") -> Column:
    """``ROUND(SUM(amount_usd))``."""
    return F.round(F.sum("amount_usd")).alias(name)


def max_volume(name: str = "maximum_bridged_volume") -> Column:
    return F.round(F.max("amount_usd")).alias(name)


def avg_volume(name: str = "average_bridged_volume", rounded: bool = True) -> Column:
    a = F.avg("amount_usd")
    return (F.round(a) if rounded else a).alias(name)


def per_user(ids: Column, users: Column) -> Column:
    """Bridges per user, one decimal; NULL (not an error) when there are no users."""
    return F.round(F.try_divide(ids, users), 1)
