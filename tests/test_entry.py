"""The panel queries stand alone: without the text operators, or without a library of theirs."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from tillroll.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["tillroll.llm", "corpus_pipeline", "public_tokenizers", "xxhash", "regex", "sentencepiece"])
def test_panel_queries_without_a_module(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    n = len(catalog.queries())
    assert [int(x) for x in out] == [n, n]
