import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


def make_points(spark, coords, ids=None, weights=None):
    """A point table from Python lists (tests only)."""
    ids = ids if ids is not None else list(range(len(coords)))
    weights = weights if weights is not None else [1.0] * len(coords)
    rows = [(int(i), [float(v) for v in c], float(w)) for i, c, w in zip(ids, coords, weights)]
    return spark.createDataFrame(rows, "point_id BIGINT, coords ARRAY<DOUBLE>, weight DOUBLE")
