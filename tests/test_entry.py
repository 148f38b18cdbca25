"""The driver's entry without the subpackage and the pipeline."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import __spark_entry__ as e
names, sql = set(e.queries()), set(e.oracle_sql())
assert "similarity_topk" in names and sql <= names
assert "pipeline" not in names and not [x for x in names if x.startswith("op1_")]
"""


@pytest.mark.parametrize("gone", [("lectern/llm",), ("lectern/llm", "corpus_pipeline.py"), ("lectern/llm", "tests/llm", "corpus_pipeline.py")])
def test_rest_works_alone(tmp_path, gone):
    for name in ("lectern", "__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
