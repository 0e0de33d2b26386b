"""The driver's entry, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_without_training_operators(tmp_path, gone):
    shutil.copytree(REPO, tmp_path / "copy", ignore=lambda _, names: [n for n in names if n in (*gone, ".git", "__pycache__", "tests")])
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path / "copy", env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    names = said.stdout.split()
    assert "retrieval" in names and not any(n == "pipeline" or n.startswith("op") and n[2].isdigit() for n in names), said.stderr
