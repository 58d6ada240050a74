"""The library without its optional modules: a real copy in which they are missing."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]
LIST = "import __spark_entry__ as e\nq = e.queries()\nassert set(e.oracle_sql()) <= set(q)\nprint(sorted(n for n in q if n[:2] == 'op' or n == 'pipeline'), len(q) > 150)"


def _copied(to: Path, without: tuple[str, ...]) -> Path:
    skip = shutil.ignore_patterns("__pycache__", ".git", "*.json", "*.txt")
    shutil.copytree(ROOT, to, ignore=lambda folder, names: {*skip(folder, names), *(n for n in names if str((Path(folder) / n).relative_to(ROOT)) in without)})
    return to


def _run(copy: Path, *command: str) -> str:
    return subprocess.run([sys.executable, *command], cwd=copy, capture_output=True, text=True, check=True).stdout


def test_entry_without_the_optional_modules(tmp_path):
    for n, without in enumerate([("tidegrid/llm", "tests/llm", "corpus_pipeline.py"), ("tidegrid/llm", "tests/llm")]):
        copy = _copied(tmp_path / str(n), without)
        assert _run(copy, "-c", LIST).strip() == "[] True"
        collected = _run(copy, "-m", "pytest", "--collect-only", "-q", "tests")
        assert "test_queries.py" in collected and "error" not in collected.splitlines()[-1]


def test_other_import_errors_are_raised(tmp_path):
    copy = _copied(tmp_path / "copy", ("tidegrid/llm", "tests/llm"))
    (copy / "tidegrid/llm").mkdir()
    (copy / "tidegrid/llm/registry.py").write_text("import no_such_module\n")
    code = "import __spark_entry__ as e\ntry:\n    e.queries()\nexcept ModuleNotFoundError as error:\n    print(error.name)"
    assert _run(copy, "-c", code).strip() == "no_such_module"


def test_nothing_else_imports_the_optional_subpackage():
    files = [p for p in (ROOT / "tidegrid").rglob("*.py") if "llm" not in p.parts] + [ROOT / "bench.py"]
    assert not [p for p in files if "tidegrid.llm" in p.read_text()]
