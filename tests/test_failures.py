import json
import os
import re
import subprocess
import sys
from pathlib import Path

from oracle import run_sql

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.01"
ROOT = Path(__file__).resolve().parents[1]


def test_tasks_that_die_halfway_leave_no_trace_in_the_result():
    run = subprocess.run(
        [sys.executable, str(ROOT / "tests" / "failing_tasks.py"), SF_DIR],
        capture_output=True,
        text=True,
        timeout=300,
        env={**os.environ, "PYTHONPATH": str(ROOT)},
    )
    assert run.returncode == 0, run.stderr[-2000:]
    # The failures of one stage are logged as lost once, with the other tasks' tracebacks.
    assert len(set(re.findall(r"Lost task \S+ in stage (\S+)", run.stderr))) == 2
    assert run.stderr.count("RuntimeError: lost on purpose") >= 8
    _, expected = run_sql(SF_DIR, contract.oracle_sql()["returned_revenue_by_region_year"])
    assert [tuple(row) for row in json.loads(run.stdout)] == expected
