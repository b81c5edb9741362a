"""Command line for scheduled jobs (run under spark-submit or python -m).

    python -m bridgelens ingest --transfers T --gmp G --out PATH [--start D] [--end D] [--routers a,b]
    python -m bridgelens report --events PATH --out DIR [--start D|all] [--end D|all] [--unit month]

``ingest`` rebuilds the months touching the range in the saved relation;
``report`` writes every frame of one dashboard refresh under DIR/<name>, all by
the executors (the driver receives only the KPI row and the median's bounded
histograms).  Without dates it covers the page's default range.  T and G are catalog table names or paths.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from bridgelens import config as C


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bridgelens")
    sub = p.add_subparsers(dest="cmd", required=True)
    i = sub.add_parser("ingest", help="build and save bridge_events for a range of months")
    i.add_argument("--transfers", required=True)
    i.add_argument("--gmp", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--format", default="parquet", help="format of path inputs")
    r = sub.add_parser("report", help="write every report of one refresh")
    r.add_argument("--events", required=True, help="path of the saved bridge_events")
    r.add_argument("--out", required=True)
    r.add_argument("--unit", default=C.DEFAULT_UNIT, choices=C.TIME_UNITS)
    r.add_argument("--approx-distinct", action="store_true", help="HyperLogLog++ distinct counts")
    i.add_argument("--routers", default=",".join(C.DEFAULT_ROUTERS))
    i.add_argument("--start", default=None, help="first day (default: all history)")
    i.add_argument("--end", default=None, help="last day (default: all history)")
    r.add_argument("--start", default=str(C.DEFAULT_START), help="first day; 'all' for all history")
    r.add_argument("--end", default=str(C.DEFAULT_END), help="last day; 'all' for all history")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"bridgelens-{args.cmd}").getOrCreate()
    if args.cmd == "ingest":
        from bridgelens.plans.ingest import ingest
        from bridgelens.sources.tables import read_gmp, read_transfers

        t = read_transfers(spark, args.transfers, args.format)
        g = read_gmp(spark, args.gmp, args.format)
        routers = [r for r in args.routers.split(",") if r]
        print(ingest(t, g, args.out, args.start, args.end, routers))
        return 0
    from bridgelens.plans.dashboard import page
    from bridgelens.plans.ingest import load_bridge_events, write_report

    out = args.out.rstrip("/")
    start, end = (None if d == "all" else d for d in (args.start, args.end))
    frames = page(load_bridge_events(spark, args.events), start, end, args.unit, out=out,
                  approx_distinct=args.approx_distinct)
    for name, frame in frames.items():  # page() has written the chain reports
        if name not in ("source_chain", "destination_chain"):
            write_report(frame, f"{out}/{name}")
    print(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
