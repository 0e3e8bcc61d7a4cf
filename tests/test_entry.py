"""The driver's contract, with and without the corpus operators."""

import os
import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 40


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "lectern").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path


def test_the_rest_works_without_them(tmp_path):
    (tmp_path / "lectern").mkdir()
    for part in (ROOT / "lectern").iterdir():
        if part.name != "llm":
            (tmp_path / "lectern" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'render_report' in q; assert set(e.oracle_sql()) <= set(q)"
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
