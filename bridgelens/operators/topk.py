"""Top-k ranking: ``orderBy(..).limit(k)`` plans as TakeOrderedAndProject,
a per-partition top-k followed by a k-row merge (no full sort)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_k(report: DataFrame, key: str, by: str, k: int = 10) -> DataFrame:
    """Rows with the ``k`` largest ``by`` values.

    Ties: by volume, then count, then name; NULL volumes go last and are
    included only when fewer than ``k`` non-null rows exist.
    """
    if by == "volume":
        order = [F.desc_nulls_last("volume_usd"), F.desc("number_of_transfers"), F.asc_nulls_first(key)]
    elif by == "count":
        order = [F.desc("number_of_transfers"), F.desc_nulls_last("volume_usd"), F.asc_nulls_first(key)]
    else:
        raise ValueError("by must be 'volume' or 'count'")
    return report.orderBy(*order).limit(k)
