import subprocess
import sys

from conftest import ROOT


def test_queries_are_listed_before_a_session():
    """Whoever lists the queries may have no Spark session yet."""
    code = "import __spark_entry__ as e; from pyspark import SparkContext as C; assert e.queries() and e.oracle_sql() and C._active_spark_context is None"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
