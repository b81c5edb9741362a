"""Scaling check: ingest + reports over the sf0.1 facts replicated k times.

Each copy shifts the ids (so distinct counts grow with k) and keeps dates, so
every month, chain and user grows k-fold: a stand-in for a larger scale
factor built by Spark from the given tables.  Prints one JSON line per k.

Usage: python tools/scale_check.py [k ...]   (default 1 4 10)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from bridgelens import (bridge_events, destination_chains, kpi, load_bridge_events,  # noqa: E402
                        save_bridge_events, source_chains, time_series, top_chains)
from bridgelens.session import local_session, scratch_path  # noqa: E402
from bridgelens.sources import TEST_ROUTERS, fixture_gmp, fixture_transfers, read_gmp, read_transfers  # noqa: E402

SF = "/root/testdata/sf0.1"
START, END = "1996-03-01", "1999-08-31"


def replicate(df, k: int):
    out = None
    for c in range(k):
        part = df.withColumn("id", F.col("id") + F.lit(c * 10_000_000_000))
        out = part if out is None else out.unionByName(part)
    return out


def main(ks):
    spark = local_session(8, 8, "bridgelens-scale")
    for k in ks:
        tp, gp = scratch_path(spark, f"scale-t{k}"), scratch_path(spark, f"scale-g{k}")
        replicate(fixture_transfers(spark, SF), k).repartition(16 * k).write.parquet(tp)
        replicate(fixture_gmp(spark, SF), k).repartition(16 * k).write.parquet(gp)
        t, g = read_transfers(spark, tp), read_gmp(spark, gp)
        times = {}

        def run(name, fn):
            t0 = time.perf_counter()
            fn()
            times[name] = round(time.perf_counter() - t0, 2)

        path = {}
        run("ingest", lambda: path.setdefault("p", save_bridge_events(bridge_events(t, g, TEST_ROUTERS))))
        ev = load_bridge_events(spark, path["p"])
        run("kpi", lambda: kpi(ev, START, END).collect())
        run("time_series_day", lambda: time_series(ev, START, END, "day").collect())
        run("source_chain", lambda: source_chains(ev).collect())
        run("top10_destination_volume", lambda: top_chains(destination_chains(ev), "volume").collect())
        print(json.dumps({"k": k, "events": ev.count(), "sec": times}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main([int(a) for a in sys.argv[1:]] or [1, 4, 10])
