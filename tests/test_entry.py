"""The driver contract, with and without the corpus part."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150 and all(callable(q) for q in queries.values())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["cell", "chrom", "pos", "count", "cpm"] and df.count() > 0


def test_without_the_corpus_part(tmp_path):
    shutil.copytree(f"{ROOT}/chromaloom", tmp_path / "chromaloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op1_') for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}).stdout.split()
    assert int(out[0]) > 150 and out[1:] == ["False", "False"]
