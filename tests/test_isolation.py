"""The package without its training-data subpackage, in a copy of the repository."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = """
import __spark_entry__ as entry
from patchlake import catalog

names = set(entry.queries())
assert names == set(catalog.QUERIES) and set(entry.oracle_sql()) <= names, names ^ set(catalog.QUERIES)
import bench
import patchlake.plans.revision, patchlake.sources.store, patchlake.sources.landed, patchlake.streaming.events
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_works_without_the_subpackage(tmp_path, pipeline):
    shutil.copytree(ROOT / "patchlake", tmp_path / "patchlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])):
        shutil.copy(ROOT / name, tmp_path / name)
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "patchlake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "patchlake").parts:
            assert "llm" not in path.read_text(), path
