"""The registry without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

from .conftest import ROOT


def test_registry_without_corpus_folder(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    assert os.path.exists(copy / "corpus_pipeline.py") and not os.path.exists(copy / "dispensa" / "llm")
    code = ("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql();"
            "assert len(q) > 70 and set(s) <= set(q) and 'pipeline' not in q and not any(k.startswith('op') for k in q)")
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
