import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])  # for the Python workers

from cataloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "8g")
    yield s
    s.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column function on a list of single values and return the results in order."""
    from pyspark.sql import functions as F

    def run(fn, items, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
        return [r["r"] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]
    return run
