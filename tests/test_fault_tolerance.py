"""A task lost mid-ingest is retried without losing or duplicating rows."""

import os
import subprocess
import sys

from bridgelens.session import scratch_path

HERE = os.path.dirname(os.path.abspath(__file__))


def test_ingest_survives_a_failed_task(spark):
    out = scratch_path(spark, "fault-ingest")
    marker = out + ".failed-once"
    env = dict(os.environ, FAULT_MARKER=marker)
    res = subprocess.run([sys.executable, os.path.join(HERE, "fault_job.py"), out],
                         capture_output=True, text=True, timeout=600, env=env)
    assert os.path.exists(marker), "the injected failure did not run"
    assert "MATCH" in res.stdout, res.stdout[-2000:] + res.stderr[-2000:]
