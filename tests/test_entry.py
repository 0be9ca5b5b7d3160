"""The core queries do not depend on what the optional ones need."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.modules["public_tokenizers"] = None
import __spark_entry__ as entry
from pulseplan.plans.catalog import all_queries
from pulseplan.plans.oracle_sql import all_oracles
assert set(entry.queries()) == set(all_queries()), "queries"
assert set(entry.oracle_sql()) == set(all_oracles()) == set(all_queries()), "SQL"
"""


def test_core_queries_without_an_optional_module():
    repo = Path(__file__).resolve().parent.parent
    ran = subprocess.run([sys.executable, "-c", CODE], cwd=repo, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
