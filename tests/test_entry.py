"""The entry without the optional corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(*sorted(set(e.queries()) | set(e.oracle_sql())))"


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_other_queries_stay_without_the_corpus_operators(tmp_path, left_out):
    from promptmill.plans.queries import QUERIES

    ignore = shutil.ignore_patterns("__pycache__", ".git", *left_out)
    for name in ("promptmill", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=ignore)
        elif source.exists() and name not in left_out:
            shutil.copy(source, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert set(said.stdout.split()) == set(QUERIES)
