"""Run the ingest with one task failing on its first attempt (used by
test_fault_tolerance.py in a separate process, since it needs a session with
task retries: master local[4,3])."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from bridgelens import bridge_events, load_bridge_events, save_bridge_events  # noqa: E402
from bridgelens.config import EVENT_COLUMNS  # noqa: E402
from bridgelens.sources import TEST_ROUTERS, fixture_gmp, fixture_transfers  # noqa: E402

SF = "/root/testdata/sf0.001"


def fail_once(batches):
    ctx = TaskContext.get()
    if ctx.partitionId() == 0 and ctx.attemptNumber() == 0:
        open(os.environ["FAULT_MARKER"], "w").close()  # proof the failure happened
        raise RuntimeError("injected task failure")
    yield from batches


def main(out: str) -> None:
    spark = (SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    t = fixture_transfers(spark, SF).repartition(4)
    flaky = t.mapInPandas(fail_once, t.schema)
    g = fixture_gmp(spark, SF)
    save_bridge_events(bridge_events(flaky, g, TEST_ROUTERS), out)
    got = sorted(tuple(map(str, r)) for r in load_bridge_events(spark, out).select(*EVENT_COLUMNS).collect())
    want = sorted(tuple(map(str, r)) for r in bridge_events(t, g, TEST_ROUTERS).collect())
    print("MATCH" if got == want else f"DIFF {len(got)} vs {len(want)}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
