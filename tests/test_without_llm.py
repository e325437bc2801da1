"""The rest of the library without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parents[1]
CODE = """
import importlib.util
import __spark_entry__ as entry
found, sql = entry.queries(), entry.oracle_sql()
assert "flagship" in found and set(sql) <= set(found)
assert not any(n == "pipeline" or n.startswith("op1_") for n in found), sorted(found)
assert importlib.util.find_spec("bench") is not None
import bench, brindle.engine
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry(tmp_path, pipeline):
    """Deleted with the pipeline, or without it."""
    shutil.copytree(TOP / "brindle", tmp_path / "brindle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", *(["corpus_pipeline.py"] if pipeline and (TOP / "corpus_pipeline.py").exists() else [])):
        shutil.copy(TOP / name, tmp_path / name)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
