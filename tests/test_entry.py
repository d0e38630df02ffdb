"""The entry points, with and without the optional corpus operators."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 1000 and set(df.columns) == {"sink", "id", "hit_timestamp", "kind", "user_id"}
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_stands_without_the_corpus_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "millrace"), tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(q) == set(e.oracle_sql()) and not any(x.startswith('op') or x == 'pipeline' for x in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "millrace")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert not re.search(r"import.*\bllm\b|\bllm\b.*import|millrace\.llm", f.read()), name


def test_queries_run_from_any_folder(tmp_path):
    """Python workers find the package though neither folder nor PYTHONPATH leads to it."""
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; from pyspark.sql import SparkSession; "
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate(); "
        "assert e.queries()['user_agent_fields'](s, '/root/testdata/sf0.001').count() == 1000"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=env)
