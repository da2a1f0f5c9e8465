"""The package loads and answers without the llm subpackage and the pipeline that stands on it."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(set(o) - set(q)), any(n.startswith('op') and n[2:3].isdigit() or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("gone", [["bourse/llm", "tests/llm", "corpus_pipeline.py"], ["bourse/llm", "tests/llm"]])
def test_loads_without_llm(tmp_path, gone):
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", *[os.path.basename(g) for g in gone]))
    assert not any(os.path.exists(copy / g) for g in gone)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    shown = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(shown[0]) > 80 and shown[1:] == ["0", "False"]


RUN = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print(e.queries()["asset_range_scan"](spark, e.SMOKE_DIR).count() > 0, e.queries()["correlation_matrix"](spark, e.SMOKE_DIR).count() > 0, e.entry(spark).count() > 0)
"""


def test_answers_without_llm(tmp_path):
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    shown = subprocess.run([sys.executable, "-c", RUN], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert shown == ["True", "True", "True"]
