"""The library, its entry module and its tests work without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("siftwood/llm", "tests/llm"), ("siftwood/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_llm(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.txt", "spark-warehouse"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        elif (copy / name).exists():
            (copy / name).unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(k.startswith('op') and k[2:3].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy), "PYTHONDONTWRITEBYTECODE": "1"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
