"""The entry file with the training-data subpackage, and without it."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [("barloom/llm", "tests/llm"), ("barloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_works_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for path in gone:
        if (copy / path).is_dir():
            shutil.rmtree(copy / path)
        elif (copy / path).exists():
            os.remove(copy / path)
    done = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    names, checked = (line.split() for line in done.stdout.strip().split("\n")[-2:])
    assert "ticker_performance" in names and "pipeline" not in names
    assert not [n for n in names if n.startswith("op")] and set(checked) <= set(names)
    used = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests", "--ignore", "tests/test_entry.py"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert used.returncode == 0, used.stdout[-800:]


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from barloom import scratch

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_folder(Session())
    Context.master = "local[4]"
    assert scratch.shared_folder(Session()).startswith("file:///")
