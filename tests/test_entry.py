"""The entry without the training-data operators, or without a library that they need."""

from __future__ import annotations

import subprocess
import sys

import pytest

HIDE = "import sys; sys.modules['{0}'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("hidden", ["xxhash", "zstandard", "fleetscope.llm", "corpus_pipeline"])
def test_other_queries_stay(hidden):
    from fleetscope.catalog.all_queries import ORACLES, QUERIES

    out = subprocess.run([sys.executable, "-c", HIDE.format(hidden)], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0])
    queries, oracles = map(int, out.stdout.split())
    assert queries >= len(QUERIES) and oracles >= len(ORACLES)
