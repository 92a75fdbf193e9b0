"""The library without its text operators: everything else still imports and registers."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_entry_without_them(tmp_path, pipeline_stays):
    shutil.copytree(os.path.join(ROOT, "lattiq"), tmp_path / "lattiq", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline_stays and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py"))):
        shutil.copy(os.path.join(ROOT, name), tmp_path)
    subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True, timeout=120)
