"""The entry without the corpus subpackage, and with one that can't be imported."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()) == len(e.oracle_sql()) == len(e.QUERIES) > 0)"


def run(folder):
    env = {**os.environ, "PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env=env, capture_output=True, text=True, check=False)


def copy(folder):
    for name in ("paperlake", "workload", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, folder / name, ignore=shutil.ignore_patterns("__pycache__", "llm"))
        else:
            shutil.copy(source, folder / name)


def test_absent(tmp_path):
    copy(tmp_path)
    assert run(tmp_path).stdout.strip() == "True"


def test_broken_subpackage_is_not_hidden(tmp_path):
    copy(tmp_path)
    (tmp_path / "paperlake" / "llm").mkdir()
    (tmp_path / "paperlake" / "llm" / "queries.py").write_text("import a_library_that_is_missing\n")
    done = run(tmp_path)
    assert done.returncode != 0 and "a_library_that_is_missing" in done.stderr
