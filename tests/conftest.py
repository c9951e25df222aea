import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_points(spark):
    schema = ("subject_id string, ord bigint, lat double, lng double, ts_sec bigint, source string, semantic_label string")

    def build(rows):
        """Rows of (ts, lat, lng[, source[, label[, subject]]])."""
        full = []
        for i, r in enumerate(rows):
            ts, lat, lng, source, label, subject = (*r, *("movement", None, "a")[len(r) - 3:])
            full.append((subject, i, float(lat), float(lng), int(ts), source, label))
        return spark.createDataFrame(full, schema)
    return build
