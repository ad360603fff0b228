"""The library stands without its optional subpackage, and nothing in it imports that."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_works_without_the_optional_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".*"))
    assert (copy / "corpus_pipeline.py").exists()
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    assert got.stdout.split()[1:] == ["False", "True"], got.stderr
    assert int(got.stdout.split()[0]) >= 75


def test_nothing_else_imports_it():
    for p in [*ROOT.glob("stockloom/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) (stockloom\.llm|corpus_pipeline)", p.read_text(), re.M), p
