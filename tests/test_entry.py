"""The driver's entry file with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"


@pytest.mark.parametrize("gone", [("lodestar/llm",), ("lodestar/llm", "corpus_pipeline.py")])
def test_engine_stands_alone(tmp_path, gone):
    for name in ("lodestar", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", *(g.split("/")[-1] for g in gone if "/" in g)))
        elif name not in gone and (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    names = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.split()
    assert "dead_code_details" in names and not [n for n in names if n == "pipeline" or n.startswith("op")]
