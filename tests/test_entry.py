"""The driver's three functions, with and without the optional parts."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(k.startswith('op') and k[2].isdigit() for k in q))"


def names(folder):
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True).stdout
    return [int(x) for x in out.split()]


def test_it_imports_with_and_without_the_optional_parts(tmp_path):
    from framelake.registry import QUERIES

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    shutil.rmtree(copy / "framelake" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(copy) == [len(QUERIES), 0]
    assert names(ROOT)[0] >= len(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["lag", "msd", "pairs"]


def test_a_broken_dependency_is_not_hidden(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    (copy / "framelake" / "llm").mkdir(exist_ok=True)
    (copy / "framelake" / "llm" / "__init__.py").touch()
    (copy / "framelake" / "llm" / "queries.py").write_text("import no_such_library\n")
    run = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True)
    assert run.returncode and "no_such_library" in run.stderr
