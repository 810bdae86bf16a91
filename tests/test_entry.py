from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

from .conftest import ROOT

SAYS = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
print(len(q), len(o), sorted(set(o) - set(q)), any(k.startswith("op") or k == "pipeline" for k in q), "q_affecting" in q)
"""


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_the_rest_lives_without_the_llm_folders(tmp_path, with_pipeline):
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    got = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    n, m, *rest = got.stdout.split(maxsplit=2)
    assert n == m and int(n) > 30 and rest == ["[] False True\n"]
