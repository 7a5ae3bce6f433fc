"""The command line lands a CSV and publishes a whole run."""

from __future__ import annotations

import json
import os
import subprocess
import sys

from fraudscope.session import scratch_path
from tests.conftest import SF001

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_land_and_publish(spark):
    from fraudscope.sources import transactions

    base = scratch_path(spark, "test-cli")
    transactions(spark, SF001).coalesce(1).write.option("header", True).csv(f"{base}/csv")
    env = {**os.environ, "PYTHONPATH": REPO}
    run = [sys.executable, "-m", "fraudscope"]
    subprocess.run(run + ["land", "--input", f"{base}/csv", "--output", f"{base}/pq"], check=True, env=env,
                   capture_output=True, timeout=600)
    out = subprocess.run(run + ["publish", "--input", f"{base}/pq", "--output", f"{base}/run", "--capacity", "5"],
                         check=True, env=env, capture_output=True, timeout=900, text=True).stdout
    paths = json.loads(out[out.index("{"):])
    assert len(paths) == 8 + 9 + 1 + 2 + 3
    assert len(open(paths["page3_threshold_comparison.txt"]).read().strip().splitlines()) == 4  # header + 3 rules
