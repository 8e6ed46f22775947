"""The rest of the repository works where the subpackage ``llm`` is absent, or only its empty folder is left."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "no pipeline"])
def test_entry_without_the_subpackage(tmp_path, left):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", *([] if left == "no pipeline" else ["llm", "corpus_pipeline.py"])))
    if left == "an empty folder":
        (at / "paperloom" / "llm" / "__pycache__").mkdir(parents=True)
    if left == "no pipeline" and (at / "corpus_pipeline.py").exists():
        (at / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q); print(sum(n.startswith('op') for n in q), 'pipeline' in q)"
    said = subprocess.run([sys.executable, "-c", code], cwd=at, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-500:]
    assert "True" not in said.stdout
