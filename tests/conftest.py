import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{shared}", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": f"{shared}/warehouse"}
    session = SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def run(spark):
    """Collect one expression over one row of named values."""
    from pyspark.sql import functions as F

    def of(expression, **values):
        row = spark.createDataFrame([tuple(values.values())], list(values)) if all(v is not None for v in values.values()) else spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
        return row.select(expression(*map(F.col, values)).alias("x")).first().x

    return of
