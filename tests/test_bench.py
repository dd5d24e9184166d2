from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

from tests.conftest import TESTDATA

ROOT = Path(__file__).resolve().parent.parent


def test_bench_prints_one_json_line():
    run = subprocess.run(
        [sys.executable, "bench.py"],
        cwd=ROOT,
        env={**os.environ, "BENCH_SF_DIR": f"{TESTDATA}/sf0.001", "BENCH_CPUS": "2", "BENCH_QUERIES": "pricing_summary"},
        capture_output=True,
        text=True,
        timeout=300,
        check=True,
    )
    (line,) = run.stdout.splitlines()
    report = json.loads(line)
    assert set(report) == {"metric", "value", "unit", "queries", "sf"}
    assert report["unit"] == "sec" and report["sf"] == "0.001"
    assert set(report["queries"]) == {"pricing_summary"}
    assert all(t > 0 for t in report["queries"].values())
