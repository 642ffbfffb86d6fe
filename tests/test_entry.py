"""The driver's entry points, with and without the text operators."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(hidden: str) -> set[str]:
    code = f"import sys; [sys.modules.__setitem__(n, None) for n in {hidden.split()!r}]\n"
    code += "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    return set(done.stdout.split())


def test_text_operators_are_optional():
    from tidegrid.catalog import all_queries

    assert names("tidegrid.llm corpus_pipeline") == set(all_queries())
    assert names("corpus_pipeline") == set(all_queries())


def test_nothing_else_imports_them():
    for folder, _, files in os.walk(os.path.join(ROOT, "tidegrid")):
        for file in files:
            if file.endswith(".py") and not folder.endswith("llm"):
                with open(os.path.join(folder, file)) as source:
                    assert "tidegrid.llm" not in source.read(), file
