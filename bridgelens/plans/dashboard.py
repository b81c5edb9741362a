"""One dashboard refresh: every report of the page from one shared relation.

The dashboard runs four statements per refresh, each recomputing the same
union of both fact tables.  Here the range's months are built once, saved, and
every report reads them.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bridgelens import config as C
from bridgelens.operators.filters import DateLike, check_range
from bridgelens.plans.ingest import ingest, load_bridge_events, write_report
from bridgelens.plans.reports import destination_chains, kpi, source_chains, time_series, top_chains
from bridgelens.session import scratch_path


def page(events: DataFrame, start: DateLike = C.DEFAULT_START, end: DateLike = C.DEFAULT_END,
         unit: str = C.DEFAULT_UNIT, *, out: str | None = None,
         approx_distinct: bool = False) -> dict[str, DataFrame]:
    """Frames of one page over an existing event relation, keyed 'kpi',
    'time_series', 'source_chain', 'destination_chain' and the four 'top10_*'
    lists.  All reports share the day range, as on the page.

    The KPI (exact median) runs eagerly, and each chain report is written once,
    under ``out`` (default: a new folder in the shared scratch space), so that
    its two top-10 lists and its own readers do not aggregate the events again.
    The time series is lazy.  ``approx_distinct`` switches every distinct count to HLL++.
    """
    check_range(start, end)
    spark = events.sparkSession
    out = (out or scratch_path(spark, "page")).rstrip("/")
    frames = {
        "kpi": kpi(events, start, end, approx_distinct=approx_distinct),
        "time_series": time_series(events, start, end, unit, approx_distinct=approx_distinct),
    }
    for name, report in (("source", source_chains), ("destination", destination_chains)):
        made = report(events, start, end, approx_distinct=approx_distinct)
        finished = _finished(spark, made, f"{out}/{name}_chain")
        frames[f"{name}_chain"] = finished
        for by in ("volume", "count"):
            frames[f"top10_{name}_{by}"] = top_chains(finished, by)
    return frames


def _finished(spark: SparkSession, report: DataFrame, path: str) -> DataFrame:
    """The report written under ``path`` and read back (one row per chain), in its order."""
    write_report(report, path)
    chain = report.columns[0]
    return spark.read.schema(report.schema).parquet(path).orderBy(F.desc("number_of_transfers"), F.asc_nulls_first(chain))


def refresh(
    transfers: DataFrame,
    gmp: DataFrame,
    start: DateLike = C.DEFAULT_START,
    end: DateLike = C.DEFAULT_END,
    unit: str = C.DEFAULT_UNIT,
    routers: Iterable[str] = C.DEFAULT_ROUTERS,
    *,
    path: str,
    out: str | None = None,
    approx_distinct: bool = False,
) -> dict[str, DataFrame]:
    """One page refresh from the fact tables: the months of the range are
    rebuilt in the relation under ``path`` (others are neither read nor
    touched), then every report of ``page`` reads it."""
    check_range(start, end)
    spark = transfers.sparkSession
    ev = load_bridge_events(spark, ingest(transfers, gmp, path, start, end, routers))
    return page(ev, start, end, unit, out=out, approx_distinct=approx_distinct)
