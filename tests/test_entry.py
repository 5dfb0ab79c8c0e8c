import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent


def test_entry_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    if not Path("/root/testdata/sf0.001").exists():
        return
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"antecedent", "decision_kind", "human_text"} <= set(rows[0].asDict())


def _copy(to, *more):
    shutil.copytree(REPO, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *more))
    return to


def _python(folder, *args):
    return subprocess.run([sys.executable, "-B", *args], cwd=folder, capture_output=True, text=True, timeout=120, env=dict(os.environ))


def test_imports_without_the_corpus_operators(tmp_path):
    repo = _copy(tmp_path / "repo", "llm", "corpus_pipeline.py")
    found = _python(repo, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))")
    assert found.returncode == 0, found.stderr
    assert int(found.stdout.split()[0]) > 80
    collected = _python(repo, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider")
    assert collected.returncode == 0, collected.stdout


def test_errors_inside_the_corpus_operators_show(tmp_path):
    if not (REPO / "turnmill" / "llm").exists():
        return
    repo = _copy(tmp_path / "repo")
    (repo / "turnmill" / "llm" / "queries.py").write_text("import no_such_module\n")
    found = _python(repo, "-c", "import __spark_entry__")
    assert found.returncode and "no_such_module" in found.stderr
