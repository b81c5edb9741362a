"""The unified bridge-event relation shared by every report."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame

from bridgelens import config as C
from bridgelens.operators.extract import gmp_events, transfer_events, union_services
from bridgelens.operators.filters import DateLike, check_range, in_date_range


def bridge_events(
    transfers: DataFrame,
    gmp: DataFrame,
    routers: Iterable[str] = C.DEFAULT_ROUTERS,
    start: DateLike = None,
    end: DateLike = None,
    *,
    filter_in_branches: bool = True,
    normalize_gmp_chains: bool = False,
    paths_in_scan: bool = True,
) -> DataFrame:
    """Completed router traffic of both services, one row per fact row.

    Columns: created_at, source_chain, destination_chain, user, amount,
    amount_usd, fee, id, service, raw_asset.  The optional inclusive date
    range is applied inside each branch (``filter_in_branches``) or on the
    union; Catalyst pushes either form into both Parquet scans.
    ``paths_in_scan=False`` is for stored VARIANT of small, unshredded documents
    (see ``transfer_events``); the rows are the same.
    """
    routers = tuple(routers)
    check_range(start, end)
    if filter_in_branches:
        t = transfer_events(transfers, routers, start, end, paths_in_scan=paths_in_scan)
        g = gmp_events(gmp, routers, start, end, normalize_chains=normalize_gmp_chains, paths_in_scan=paths_in_scan)
        return union_services(t, g)
    t = transfer_events(transfers, routers, paths_in_scan=paths_in_scan)
    g = gmp_events(gmp, routers, normalize_chains=normalize_gmp_chains, paths_in_scan=paths_in_scan)
    return in_date_range(union_services(t, g), start, end)
