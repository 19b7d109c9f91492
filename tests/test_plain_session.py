"""Queries run on a session the caller made, without the library's own settings."""
import os
import subprocess
import sys

CODE = """
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
assert entry.entry(spark).count() > 0
for name in ("log_facets", "lb_totals", "stage_judge"):
    assert entry.queries()[name](spark, entry.SMALL).count() > 0, name
print("all ran")
"""


def test_queries_run_on_a_plain_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", CODE], cwd=root, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-2000:]
