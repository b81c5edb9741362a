"""bridgelens: cross-chain bridge analytics as Spark DataFrame plans.

Typical use::

    from bridgelens import bridge_events, kpi, time_series, source_chains, top_chains
    ev = bridge_events(spark.table("fact_transfers"), spark.table("fact_gmp"))
    kpi(ev, "2024-01-01", "2025-08-31").show()
"""

from bridgelens.plans import (
    bridge_events, chain_labels, chain_report, destination_chains, ingest, kpi, kpi_labels,
    load_bridge_events, page, refresh, save_bridge_events, source_chains, time_series, top_chains,
    write_report,
)

__all__ = [
    "bridge_events", "chain_labels", "chain_report", "destination_chains", "ingest", "kpi", "kpi_labels",
    "load_bridge_events", "page", "refresh", "save_bridge_events", "source_chains", "time_series", "top_chains",
    "write_report",
]
