"""Vector column functions (V1-V10) in both unrolled and higher-order forms."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import make_points
from tessera.functions import vectors as V


@pytest.fixture(scope="module")
def pts(spark):
    return make_points(spark, [[3.0, 4.0], [0.0, -0.0], [1.5, -2.5], [3.0, 4.0]])


def test_distance_forms_agree(pts):
    c = [1.0, 1.0]
    rows = pts.select(V.distance("coords", c).alias("a"),
                      V.distance("coords", F.array(F.lit(1.0), F.lit(1.0)), None).alias("b")).collect()
    for r in rows:
        assert r["a"] == pytest.approx(r["b"], rel=1e-15)
    assert rows[0]["a"] == pytest.approx(math.sqrt(4 + 9))


def test_norms(pts):
    r = pts.select(V.norm("coords", 2).alias("n2"), V.norm("coords").alias("nh"),
                   V.squared_norm("coords", 2).alias("s")).first()
    assert r["n2"] == r["nh"] == 5.0 and r["s"] == 25.0


def test_arithmetic(pts):
    r = pts.select(V.add("coords", "coords").alias("a"), V.subtract("coords", [1.0, 1.0]).alias("s"),
                   V.scale("coords", 2.0).alias("k"), V.dimension("coords").alias("d"),
                   V.coord("coords", 1).alias("y")).first()
    assert r["a"] == [6.0, 8.0] and r["s"] == [2.0, 3.0] and r["k"] == [6.0, 8.0]
    assert r["d"] == 2 and r["y"] == 4.0


def test_equality_and_text(pts):
    rows = pts.select("point_id", V.equal("coords", [3.0, 4.0]).alias("eq"),
                      V.equal("coords", [0.0, 0.0]).alias("zero"), V.to_text("coords").alias("t")).collect()
    assert [r["eq"] for r in rows] == [True, False, False, True]
    assert rows[1]["zero"]              # -0.0 equals 0.0
    assert rows[2]["t"] == "1.5,-2.5"


def test_lexicographic_index(pts):
    got = {r["point_id"]: r["ord"] for r in V.lexicographic_index(pts).collect()}
    assert got == {1: 0, 2: 1, 0: 2, 3: 3}


def test_sum_vectors(pts):
    r = pts.agg(*V.sum_vectors("coords", 2)).first()
    assert (r["s0"], r["s1"]) == (7.5, 5.5)
