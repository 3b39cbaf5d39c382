"""The entry without the training-data operators, or without a library that they need."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
COUNT = """
import sys
for name in {hidden!r}:
    sys.modules[name] = None
import __spark_entry__ as e
from cohortloom.plans import registry
assert set(e.queries()) == set(registry.QUERIES) and set(e.oracle_sql()) == set(registry.ORACLES)
print(len(e.queries()))
"""


def count(hidden):
    out = subprocess.run([sys.executable, "-c", COUNT.format(hidden=hidden)], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    return int(out.stdout.split()[-1])


def test_other_queries_stay():
    assert count(["xxhash"]) == count(["cohortloom.llm"]) == count(["corpus_pipeline"]) >= 176
