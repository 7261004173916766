"""The queries run where workers can't import the package."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", "{repo}/__spark_entry__.py")
e = importlib.util.module_from_spec(spec)
spec.loader.exec_module(e)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", e.queries()["{name}"](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("name", ["p6_ids", "p7_packed", "p8_found"])
def test_runs_from_another_folder_without_a_path(name, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", CODE.format(repo=REPO, name=name)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in ran.stdout, ran.stderr[-2000:]
