"""The whole run (M1): shape, report rows, seed stability across partitionings."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tessera.plans import run as PL
from tessera.plans.fixtures import PART


def _run(spark, parts):
    pts = PART.load(spark, SF001).repartition(parts)
    return PL.cluster(pts, 5, 20, 2, seed=3)


def test_run_outputs(spark):
    res = _run(spark, 4)
    assert res.centers.count() == 5
    assert res.assignments.count() == 200
    m = {(r["phase"], r["iteration"], r["metric"]): r["value"] for r in res.metrics.collect()}
    assert m[("grid", 0, "n")] == 200
    assert ("phase1", 0, "cost") in m and ("phase2", 1, "cost") in m
    assert m[("phase2", 1, "cost")] <= m[("phase1", 0, "cost")] + 1e-6
    assert {r["kind"] for r in res.centers.collect()} == {"median"}


def test_same_seed_same_result_on_any_partitioning(spark):
    a = _run(spark, 1).center_list
    b = _run(spark, 7).center_list
    for (_, x), (_, y) in zip(a, b):
        assert x == pytest.approx(y, abs=1e-9)


def test_written_result(spark, tmp_path):
    res = _run(spark, 2)
    PL.write_cluster_result(res, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "centers"))
    assert back.count() == 5


def test_one_center_and_one_dimension(spark):
    from tessera.plans.fixtures import CUSTOMER
    pts = CUSTOMER.load(spark, SF001)
    res = PL.cluster(pts, 1, 10, 1)
    assert res.centers.count() == 1
    assert res.assignments.where(F.col("center_id") != 0).count() == 0
    # the 1-d geometric median is a median of the values
    vals = sorted(r["coords"][0] for r in pts.collect())
    c = res.center_list[0][1][0]
    below = sum(v < c - 1e-6 for v in vals)
    above = sum(v > c + 1e-6 for v in vals)
    assert abs(below - above) <= 2


def test_no_refinement_returns_medoids(spark):
    pts = PART.load(spark, SF001)
    res = PL.cluster(pts, 3, 20, 0)
    assert {r["kind"] for r in res.centers.collect()} == {"medoid"}
    ids = {tuple(r["coords"]) for r in pts.collect()}
    assert all(tuple(c) in ids for _, c in res.center_list)
    assert not [m for m in res.metric_rows if m[0] == "phase2"]


def test_tau_one_makes_every_distinct_point_a_medoid(spark):
    pts = PART.load(spark, SF001)
    res = PL.cluster(pts, 3, 1, 1)
    m = {(p, i, name): v for p, i, name, v in res.metric_rows}
    distinct = pts.select("coords").distinct().count()
    assert m[("sample", 0, "sample_size")] == distinct
