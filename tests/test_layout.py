"""The optional parts may be deleted: the rest still imports and lists its queries."""

import shutil
import subprocess
import sys

import pytest
from conftest import ROOT


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_without_the_optional_parts(tmp_path, also):
    at = tmp_path / "repo"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for gone in ("quillon/llm", "tests/llm"):
        shutil.rmtree(at / gone, ignore_errors=True)
    for gone in also:
        (at / gone).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(s) <= set(q) and not [n for n in q if n[:2] == 'op' or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=at, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(at)})


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "quillon").rglob("*.py"):
        if path.parent.name != "llm":
            assert "llm" not in path.read_text(), path
