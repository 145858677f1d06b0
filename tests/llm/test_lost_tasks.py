import json
import os
import subprocess
import sys
from pathlib import Path

from millrace.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
HERE = Path(__file__).resolve().parent


def test_tasks_that_die_with_their_files_written_change_nothing(spark):
    run = subprocess.run(
        [sys.executable, str(HERE / "lost_tasks.py"), SF_DIR],
        capture_output=True,
        text=True,
        timeout=600,
        env={**os.environ, "PYTHONPATH": str(HERE.parents[1])},
    )
    assert run.returncode == 0, run.stderr[-2000:]
    assert run.stderr.count("RuntimeError: lost on purpose") >= 12
    got = json.loads(run.stdout)

    def expected(query, *columns):
        return sorted([r[c] for c in columns] for r in QUERIES[query](spark, SF_DIR).collect())

    assert got["counts"] == expected("op6_token_counts", "doc_id", "n_tokens")
    assert got["records"] == expected("op8_token_records", "doc_id", "start", "n_tokens")
    assert got["warc"] == expected("op7_warc", "page_id", "text_digest")
    assert got["near"] == expected("op3_minhash", "doc_id", "component_id")
