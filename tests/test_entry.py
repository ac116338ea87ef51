"""The entry imports, and the other queries are there, when the optional subpackage and its tests are deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

from glossmill.plans import registry

REPO = Path(__file__).resolve().parent.parent


def test_entry_without_the_optional_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    assert not (copy / "glossmill" / "llm").exists() and not (copy / "tests" / "llm").exists()
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=copy, capture_output=True, text=True, check=True)
    names, oracles = (set(line.split()) for line in said.stdout.splitlines())
    assert set(registry.queries()) <= names and set(registry.oracles()) <= oracles
    assert not any(n.startswith("op") or n == "pipeline" for n in names)


def test_entry_imports_nothing_optional_for_the_library():
    for path in (REPO / "glossmill").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "glossmill.llm" not in path.read_text() and "from ..llm" not in path.read_text(), path
