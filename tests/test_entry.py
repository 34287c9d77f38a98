"""The entry points answer without a Spark session."""

import subprocess
import sys
from pathlib import Path


def test_names_need_no_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), len(s))"], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) > 250
