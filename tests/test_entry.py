"""The entry point without the training-text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); assert 'session_usage' in q and not [k for k in q if k[:2] == 'op' or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q); print(len(q))"


def test_works_without_the_text_operators(tmp_path):
    for keep_pipeline in (False, True):
        there = tmp_path / str(keep_pipeline)
        shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "llm", "spark-warehouse", "__pycache__", *([] if keep_pipeline else ["corpus_pipeline.py"])))
        out = subprocess.run([sys.executable, "-c", CODE], cwd=there, env=os.environ | {"PYTHONPATH": str(there)}, capture_output=True, text=True)
        assert out.returncode == 0, out.stderr
