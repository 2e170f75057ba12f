"""Per-application memos (materialised fact, size checks, models) are
rebuilt for a new SparkContext in the same process, with equal results.
Runs in its own process so it can stop and restart Spark."""

import os
import subprocess
import sys

from conftest import SF_SMALL

SCRIPT = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
import __spark_entry__ as E
seen = []
for _ in range(2):
    s = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    rows = sorted(tuple(r) for r in E.queries()["readmission_rates"](s, {SF_SMALL!r}).collect())
    cost = sorted(tuple(r) for r in E.queries()["avg_cost"](s, {SF_SMALL!r}).collect())
    seen.append((s.sparkContext.applicationId, rows, cost))
    s.stop()
assert seen[0][0] != seen[1][0]
assert seen[0][1:] == seen[1][1:]
print("restart-ok")
"""


def test_queries_survive_a_context_restart():
    out = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, timeout=600)
    assert "restart-ok" in out.stdout, out.stderr[-2000:]
