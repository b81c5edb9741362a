"""Composite plans: the unified relation, the reports and the ingest job."""

from bridgelens.plans.dashboard import page, refresh
from bridgelens.plans.events import bridge_events
from bridgelens.plans.ingest import ingest, load_bridge_events, save_bridge_events, write_report
from bridgelens.plans.reports import (
    chain_labels, chain_report, destination_chains, kpi, kpi_labels, source_chains,
    time_series, top_chains,
)

__all__ = [
    "bridge_events", "chain_labels", "ingest", "chain_report", "destination_chains", "kpi", "kpi_labels",
    "load_bridge_events", "page", "refresh", "save_bridge_events", "source_chains", "time_series", "top_chains",
    "write_report",
]
