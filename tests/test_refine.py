"""Geometric-median refinement against numpy, plus D2 and D8 regressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01, make_points
from tessera.operators import assign as A
from tessera.operators import refine as W
from tessera.plans.fixtures import PART, first_k_centers


def numpy_median(X, w, iters=20000):
    """Plain Weiszfeld with the Vardi-Zhang step, run long."""
    x = X.mean(axis=0)
    for _ in range(iters):
        d = np.sqrt(((X - x) ** 2).sum(axis=1))
        at = d == 0
        inv = np.where(at, 0.0, w / np.where(at, 1.0, d))
        R = (inv[:, None] * (X - x)).sum(axis=0)
        den = inv.sum()
        wat = w[at].sum()
        if wat == 0:
            nx = x + R / den
        else:
            rn = np.linalg.norm(R)
            nx = x if rn <= wat else x + (rn - wat) / den * R / rn
        if np.linalg.norm(nx - x) < 1e-13:
            return nx
        x = nx
    return x


def objective(X, w, x):
    return float((w * np.sqrt(((X - x) ** 2).sum(axis=1))).sum())


def test_median_matches_long_numpy_run(spark):
    pts = PART.load(spark, SF01)
    rows = pts.collect()
    X = np.array([r["coords"] for r in rows])
    w = np.ones(len(X))
    start = [float(rows[0]["coords"][0]), float(rows[0]["coords"][1])]
    asg = pts.select("coords", "weight", F.lit(0).alias("center_id"))
    res = W.geometric_medians(asg, {0: start}, 2, epsilon=1e-5)
    ref = numpy_median(X, w)
    got = np.array(res.centers[0])
    assert objective(X, w, got) == pytest.approx(objective(X, w, ref), rel=1e-9)
    assert np.linalg.norm(got - ref) < 1e-3


def test_anchor_step_descends(spark):
    """From a data point the step follows +R and lowers the objective,
    also on data squeezed into [0, 0.01] where a wrong step stalls."""
    rows = PART.load(spark, SF01).collect()
    X = np.array([r["coords"] for r in rows])
    X = (X - X.min(axis=0)) / (X.max(axis=0) - X.min(axis=0)) * 0.01
    pts = make_points(spark, X.tolist())
    asg = pts.select("coords", "weight", F.lit(0).alias("center_id"))
    x0 = X[5].tolist()
    st = W.pass_stats(asg, {0: x0}, 2).first()
    new, branch = W.weiszfeld_update(x0, [st["r_0"], st["r_1"]], st["den"], st["w_at"])
    assert branch == "S"
    w = np.ones(len(X))
    assert objective(X, w, np.array(new)) < objective(X, w, np.array(x0))
    res = W.geometric_medians(asg, {0: x0}, 2, epsilon=W.EPSILON)
    assert objective(X, w, np.array(res.centers[0])) < objective(X, w, np.array(x0))


def test_equal_centers_keep_both(spark):
    """Two equal centers; the second gets no points and keeps its place."""
    pts = make_points(spark, [[0, 0], [1, 0], [0, 1], [5, 5], [6, 5]])
    centers = [(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [5.0, 5.0])]
    new, res = W.refine_once(pts, centers, 2)
    assert [j for j, _ in new] == [0, 1, 2]
    assert new[1][1] == [0.0, 0.0]
    assert res.passes[1] == 0


def test_refinement_never_raises_cost(spark):
    pts = PART.load(spark, SF01)
    ctr = first_k_centers(pts, 5)
    before = A.clustering_cost_value(pts, ctr)
    new, _ = W.refine_once(pts, ctr, 2, epsilon=1e-3)
    after = A.clustering_cost_value(pts, new)
    assert after <= before


def test_merged_points_give_the_same_medians(spark):
    coords = [[1.0, 1.0]] * 30 + [[float(i), float(i % 4)] for i in range(20)]
    pts = make_points(spark, coords)
    centers = [(0, [1.0, 1.0]), (1, [15.0, 2.0])]
    a, _ = W.refine_once(pts, centers, 2, epsilon=0.0, max_passes=8)
    b, _ = W.refine_once(W.merge_duplicates(pts), centers, 2, epsilon=0.0, max_passes=8)
    for (_, x), (_, y) in zip(a, b):
        assert x == pytest.approx(y, abs=1e-9)


@pytest.mark.parametrize("terms", [W.UNROLL_TERMS, 0])
def test_sparse_and_negative_center_ids(spark, monkeypatch, terms):
    """Estimates as a literal map or a broadcast table, whatever the ids are."""
    monkeypatch.setattr(W, "UNROLL_TERMS", terms)
    pts = make_points(spark, [[0, 0], [1, 0], [0, 1], [50, 50], [51, 50], [50, 51.5]])
    near = [(0, [0.2, 0.2]), (1, [50.2, 50.2])]
    want, _ = W.refine_once(pts, near, 2, epsilon=0.0, max_passes=4)
    for ids in ((0, 20000), (-1, 2 ** 31 - 1), (7, 3)):
        got, res = W.refine_once(pts, [(ids[0], near[0][1]), (ids[1], near[1][1])], 2, epsilon=0.0, max_passes=4)
        assert [j for j, _ in got] == list(ids) and set(res.passes) == set(ids)
        for (_, x), (_, y) in zip(got, want):
            assert x == pytest.approx(y, abs=1e-9)


def test_nearest_forms_agree_on_odd_rows(spark):
    """Ties, overflow, infinity and NaN: the expression and the batched form
    give the same rows, in whatever order the centers come."""
    nan, inf = float("nan"), float("inf")
    pts = make_points(spark, [[0, 0], [1e200, 0], [-1e200, 1e200], [inf, 0], [nan, 0], [1, 1], [0.5, 0]])
    few = [(4, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 0.0]), (0, [1e200, 5.0]), (9, [nan, 0.0])]
    many = few + [(100 + i, [1e150, 1e150 + i]) for i in range(30)]      # beyond UNROLL_TERMS
    assert len(few) * 2 <= A.UNROLL_TERMS < len(many) * 2

    def rows(centers):
        return {r["point_id"]: (r["center_id"], repr(r["distance"])) for r in A.assign_nearest(pts, centers).collect()}
    old = A.UNROLL_TERMS
    try:
        for centers in (few, many, few[::-1], many[::-1]):
            A.UNROLL_TERMS = 0
            batched = rows(centers)
            A.UNROLL_TERMS = 10 ** 6
            assert rows(centers) == batched
    finally:
        A.UNROLL_TERMS = old
    assert rows(few)[0][0] == 1 and rows(few)[6][0] == 1


@pytest.mark.parametrize("scale,most", [((1.0, 1.0), 12), ((1.0, 1000.0), 30), ((1e-4, 1.0), 60)])
def test_second_order_passes_reach_the_median_in_few_scans(spark, scale, most):
    """Also of points nearly on a line, where plain steps take hundreds."""
    pts = PART.load(spark, SF01)
    X = np.array([r["coords"] for r in pts.collect()]) * scale
    start = X[0].tolist()
    asg = make_points(spark, X.tolist()).select("coords", "weight", F.lit(0).alias("center_id"))
    res = W.geometric_medians(asg, {0: start}, 2, epsilon=1e-7, method="newton")
    ref = numpy_median(X, np.ones(len(X)))
    assert np.allclose(res.centers[0], ref, atol=1e-4)
    assert res.passes[0] < most


def test_second_order_passes_stop_at_a_data_point(spark):
    """Medians at a point of much weight, of a few points, on a line, and of copies of one point."""
    rng = np.random.default_rng(8)
    clusters = [np.r_[rng.normal(size=(40, 2)), [[0.3, 0.2]] * 60], rng.normal(size=(3, 2)), np.c_[np.arange(9.0), np.arange(9.0)],
                np.array([[1.0, 2.0]] * 5), np.r_[rng.normal(size=(20, 2)), rng.normal(size=(20, 2)) + 50]]
    rows = [(j, x.tolist()) for j, X in enumerate(clusters) for x in X]
    asg = (spark.createDataFrame(rows, "center_id INT, coords ARRAY<DOUBLE>").withColumn("weight", F.lit(1.0))
           .groupBy("center_id", "coords").agg(F.sum("weight").alias("weight")))
    start = {j: (X.mean(axis=0) + 0.01).tolist() for j, X in enumerate(clusters)}
    res = W.geometric_medians(asg, start, 2, epsilon=1e-8, max_passes=40, method="newton")
    for j, X in enumerate(clusters):
        ref = numpy_median(X, np.ones(len(X)))
        assert objective(X, 1, np.array(res.centers[j])) == pytest.approx(objective(X, 1, ref), rel=1e-7, abs=1e-7), j
        assert res.passes[j] < 25


def test_refined_runs_agree_by_method(spark):
    pts = PART.load(spark, SF01)
    ctr = first_k_centers(pts, 5)
    plain, a = W.refine_once(pts, ctr, 2, epsilon=1e-7, method="weiszfeld")
    fast, b = W.refine_once(pts, ctr, 2, epsilon=1e-5)
    for (_, x), (_, y) in zip(plain, fast):
        assert x == pytest.approx(y, abs=1e-4)
    assert 2 * b.jobs < a.jobs
    with pytest.raises(ValueError):
        W.refine_once(pts, ctr, 2, method="steepest")


@pytest.mark.parametrize("d,k", [(1, 200), (2, 1000), (3, 64), (2, 10)])
def test_indexed_centers_give_the_plain_nearest(d, k):
    """Bounds pass over groups, never over a nearest center; ties, copies and odd rows included."""
    rng = np.random.default_rng(d * k)
    C = np.round(rng.uniform(0, 50, (k, d)), 1)
    X = np.r_[np.round(rng.uniform(-5, 60, (3000, d)), 1), C[:50], [[np.nan] * d], [[np.inf] * d], [[1e200] * d]]
    index = A.CenterIndex(C)
    dist, at = index.nearest(X)
    few = index.distances
    plain = A.CenterIndex(C)
    plain.bounded = False
    want, first = plain.nearest(X)
    assert np.array_equal(dist, want, equal_nan=True) and np.array_equal(at, first)
    D = np.sqrt(sum((X[:3050, i, None] - C[None, :, i]) ** 2 for i in range(d)))
    assert np.array_equal(at[:3050], D.argmin(axis=1))
    if k == 1000:
        assert few < len(X) * k / 5
    same = A.CenterIndex(np.repeat(C[:1], 100, axis=0))
    assert np.all(same.nearest(X[:100])[1] == 0)
