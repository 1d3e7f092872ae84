"""The driver's contract."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["px", "b1", "b2", "b3", "n"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.oracle_sql()) > 70


def test_nothing_else_imports_the_training_operators():
    for path in (ROOT / "skyloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_queries_without_the_training_operators(tmp_path, pipeline_too):
    """The other queries are there when the subpackage (and the pipeline) is not."""
    gone = {"llm", *(["corpus_pipeline.py"] if pipeline_too else [])}
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda _, names: [n for n in names if n in gone or n.startswith((".git", "__pycache__"))])
    code = "import __spark_entry__ as e; from skyloom.plans import catalogue as c; assert set(e.queries()) == set(c.QUERIES); assert set(e.oracle_sql()) == set(c.SQL)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, check=True, timeout=120)
