"""The driver's contract without the training-data subpackage, or without a library that it needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("hidden", ["zstandard", "ahocorasick", "cellweave.llm", "corpus_pipeline"])
def test_entry_without(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len([k for k in q if k[:2] != 'op' and k != 'pipeline']), set(o) <= set(q), any(k.startswith('op1_') for k in q), 'pipeline' in q)"
    n, subset, operators, pipeline = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120).stdout.split()
    assert int(n) > 390 and subset == "True" and (pipeline == "False" or hidden == "ahocorasick")
    assert operators == str(hidden == "corpus_pipeline" and os.path.isdir(os.path.join(ROOT, "cellweave", "llm")))
