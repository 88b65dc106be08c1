"""The entry without the corpus subpackage: everything else is still there."""

from __future__ import annotations

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def listed(folder) -> list[list[str]]:
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return json.loads(done.stdout.splitlines()[-1])


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_corpus_operators(tmp_path, pipeline):
    from tabloom.catalog import ORACLES, QUERIES

    copy = tmp_path / "copy"
    copy.mkdir()
    shutil.copytree(ROOT / "tabloom", copy / "tabloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", copy)
    assert listed(copy) == [sorted(QUERIES), sorted(ORACLES)]
