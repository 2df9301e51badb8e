"""A third of all rows on one point: the merge collapses it map-side, its
leaf is one row for PAM, and the run's results stay whole."""

import random

from pyspark.sql import functions as F

from conftest import make_points
from tessera.operators import grid as G
from tessera.operators import sample as SM
from tessera.plans import run as PL


def _skewed(spark, n=3000):
    rng = random.Random(5)
    hot = [[50.0, 50.0]] * (n // 3)
    rest = [[rng.uniform(0, 100), rng.uniform(0, 100)] for _ in range(n - n // 3)]
    return make_points(spark, hot + rest).repartition(6)


def test_hot_point_is_one_merged_row(spark):
    pts = _skewed(spark)
    grid = G.adaptive_grid(pts, 30, 2)
    merged = SM.merged_cells(grid)
    hot = merged.where(F.col("n") == 1000).collect()
    assert len(hot) == 1 and list(hot[0]["coords"]) == [50.0, 50.0]
    assert merged.agg(F.sum("n")).first()[0] == 3000
    # the hot leaf holds copies only, every other leaf at most tau points
    per = grid.points.groupBy("cell_key").agg(F.count("*").alias("n"),
                                              F.countDistinct("coords").alias("nd")).collect()
    assert all(r["n"] <= 30 or r["nd"] == 1 for r in per)


def test_merge_aggregates_before_the_shuffle(spark):
    pts = _skewed(spark)
    grid = G.adaptive_grid(pts, 30, 2)
    plan = SM.merged_cells(grid)._jdf.queryExecution().executedPlan().toString()
    # a partial aggregate sits below the exchange that groups the copies
    assert "partial_count" in plan


def test_run_on_skewed_table_keeps_every_row(spark):
    pts = _skewed(spark)
    res = PL.cluster(pts, 4, 30, 1)
    assert res.assignments.count() == 3000
    hot_center = res.assignments.where(F.col("point_id") < 1000).select("center_id").distinct().count()
    assert hot_center == 1
