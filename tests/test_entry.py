"""The driver's contract, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_operator_folders(tmp_path):
    """A copy without the two folders, and with or without the pipeline's file, registers the library's own queries."""
    for pipeline in (True, False):
        copy = tmp_path / f"copy{pipeline}"
        gone = ["llm", ".git", "__pycache__"] + ([] if pipeline else ["corpus_pipeline.py"])
        shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(*gone))
        ask = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 30 and set(o) <= set(q); assert not [n for n in q if n.startswith('op') or n == 'pipeline']"
        subprocess.run([sys.executable, "-c", ask], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": ""})
