"""The driver contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print('NAMES', *sorted(e.queries())); print('SQL', *sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout
    return tuple(set(line.split()[1:]) for line in out.splitlines() if line.startswith(("NAMES", "SQL")))


def test_entry_without_the_subpackage(tmp_path):
    for p in ("factloom", "__spark_entry__.py"):
        source = os.path.join(REPO, p)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / p)
    shutil.rmtree(tmp_path / "factloom/llm", ignore_errors=True)
    queries, sql = names(tmp_path)
    assert "fused_search" in queries and len(queries) > 70 and sql <= queries
    assert not any(q.startswith("op") or q == "pipeline" for q in queries - {"ordered_distinct"})
    (tmp_path / "factloom/llm").mkdir()  # an emptied folder counts as absent
    assert names(tmp_path)[0] == queries


def test_entry_is_the_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["qid", "fact_text", "source", "score", "rank"] and rows.count() == 50


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(REPO, "factloom")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f), encoding="utf-8") as text:
                        assert "factloom.llm" not in text.read()
