"""Print the physical plans of the main queries (trees plus scan details).

Usage: python tools/show_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bridgelens import (bridge_events, load_bridge_events, save_bridge_events,  # noqa: E402
                        source_chains, time_series, top_chains)
from bridgelens.operators.filters import in_date_range  # noqa: E402
from bridgelens.operators.quantile import median_stats  # noqa: E402
from bridgelens.plans.ingest import write_layout  # noqa: E402
from bridgelens.plans.reports import kpi_measures  # noqa: E402
from bridgelens.session import local_session  # noqa: E402
from bridgelens.sources import TEST_ROUTERS, fixture_gmp, fixture_transfers  # noqa: E402

KEEP = re.compile(r"^(\S.*|\s*[+:|-].*)$")


def formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def summary(plan: str) -> str:
    """The operator tree and the scan lines (location, filters, schema)."""
    tree, details = plan.split("\n\n\n", 1) if "\n\n\n" in plan else (plan, "")
    scan = [l for l in details.splitlines()
            if l.startswith(("PartitionFilters", "PushedFilters", "ReadSchema", "(", "Arguments: hashpartitioning",
                             "Arguments: rangepartitioning", "Arguments: SinglePartition",
                             "Arguments: RebalancePartitioning", "Arguments: rebalance"))
            and ("Scan" in l or not l.startswith("("))]
    return tree.strip() + "\n\n" + "\n".join(scan)


def main(sf: str) -> None:
    spark = local_session(8)
    ev = bridge_events(fixture_transfers(spark, sf), fixture_gmp(spark, sf), TEST_ROUTERS)
    saved = load_bridge_events(spark, save_bridge_events(ev))
    S, E = "1996-03-01", "1999-08-31"
    shown = {
        "bridge_events over the raw facts, day range (ingest side)": bridge_events(
            fixture_transfers(spark, sf), fixture_gmp(spark, sf), TEST_ROUTERS, S, E),
        "ingest write layout (rebalance by month, sort by day per task)": write_layout(ev),
        "time_series(month) over the saved relation": time_series(saved, S, E, "month"),
        "KPI aggregate over the saved relation (measures + median count/min/max)": in_date_range(
            saved, S, E).agg(*kpi_measures(), *median_stats("amount_usd")),
        "source_chains over the saved relation": source_chains(saved),
        "top-10 source chains by volume": top_chains(source_chains(saved), "volume"),
    }
    print("# Physical plans\n")
    print(f"Generated by `tools/show_plans.py {sf}` (local[8], AQE on; trees are pre-AQE).\n")
    for title, df in shown.items():
        print(f"## {title}\n\n```\n{summary(formatted(df))}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
