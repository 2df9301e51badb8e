"""Gridding: edge cases D3-D7 and properties of the adaptive leaves."""

import math
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF01, make_points
from tessera.operators import grid as G
from tessera.operators import sample as SM
from tessera.plans.fixtures import EVENTS, PART


def simulate(points, tau, spec):
    """Literal level-by-level split of over-full cells (midpoint rule)."""
    cells = {}
    for pid, x in points:
        c = []
        for i in range(spec.d):
            if not spec.active[i]:
                c.append(0)
                continue
            c.append(min(math.floor((x[i] - spec.mins[i]) / spec.side), spec.parts[i] - 1))
        lo = [spec.mins[i] + c[i] * spec.side if spec.active[i] else spec.mins[i] for i in range(spec.d)]
        hi = [lo[i] + spec.side if spec.active[i] else spec.mins[i] for i in range(spec.d)]
        cells.setdefault(tuple(c), (lo, hi, []))[2].append((pid, x))
    leaves, splits, work = [], 0, list(cells.values())
    while work:
        nxt = []
        for lo, hi, members in work:
            same = all(m[1] == members[0][1] for m in members)
            if len(members) <= tau or same:
                leaves.append(members)
                continue
            splits += 1
            kids = {}
            for pid, x in members:
                b = tuple(int(x[i] >= (lo[i] + hi[i]) / 2) if spec.active[i] else 0 for i in range(spec.d))
                kids.setdefault(b, []).append((pid, x))
            for b, mem in kids.items():
                half = [(hi[i] - lo[i]) / 2 for i in range(spec.d)]
                nlo = [lo[i] + b[i] * half[i] for i in range(spec.d)]
                nhi = [nlo[i] + half[i] for i in range(spec.d)]
                nxt.append((nlo, nhi, mem))
        work = nxt
    return leaves, splits


@pytest.mark.parametrize("tau,occupied,total", [(5, 778, 870), (20, 244, 246), (100, 46, 46)])
def test_adaptive_grid_equals_literal_split_on_part(spark, tau, occupied, total):
    pts = PART.load(spark, SF01)
    grid = G.adaptive_grid(pts, tau, 2)
    rows = pts.collect()
    leaves, splits = simulate([(r["point_id"], list(r["coords"])) for r in rows], tau, grid.spec)
    assert grid.n_splits == splits
    assert grid.n_cells == total
    got = {}
    for r in grid.points.select("point_id", "cell_key").collect():
        got.setdefault(r["cell_key"], set()).add(r["point_id"])
    assert len(got) == occupied == len(leaves)
    assert sorted(sorted(v) for v in got.values()) == sorted(sorted(p for p, _ in m) for m in leaves)


def test_leaves_hold_at_most_tau_and_contain_their_points(spark):
    pts = PART.load(spark, SF01)
    grid = G.adaptive_grid(pts, 20, 2)
    cells = {r["cell_key"]: r for r in G.adaptive_cells(grid).collect()}
    for c in cells.values():
        assert c["n"] <= 20
    seen = set()
    for r in grid.points.select("point_id", "coords", "cell_key").collect():
        assert r["point_id"] not in seen
        seen.add(r["point_id"])
        c = cells[r["cell_key"]]
        for i in range(2):
            assert c["lo"][i] - 1e-9 <= r["coords"][i] <= c["hi"][i] + 1e-9
    assert len(seen) == 2000


def test_upper_edge_point_is_clamped(spark):
    """D3: d = 1, n = 100, tau = 10 puts x = 99 exactly on the grid's end."""
    pts = make_points(spark, [[float(i)] for i in range(100)])
    spec = G.grid_spec(pts, 10, 1)
    assert spec.parts == [10]
    g = G.uniform_grid_assign(pts, spec)
    top = g.where(F.col("point_id") == 99).first()
    assert top["cell"] == 9
    grid = G.adaptive_grid(pts, 10, 1, spec=spec)
    assert grid.points.count() == 100


def test_many_copies_of_one_point_terminate(spark):
    """50 copies of one point and tau 5 make one leaf of copies."""
    coords = [[1.0, 1.0]] * 50 + [[float(i), float(i % 3)] for i in range(2, 12)]
    pts = make_points(spark, coords)
    grid = G.adaptive_grid(pts, 5, 2)
    sizes = {r["cell_key"]: r["n"] for r in grid.points.groupBy("cell_key").agg(F.count("*").alias("n")).collect()}
    assert max(sizes.values()) == 50
    assert sum(sizes.values()) == 60
    merged = SM.merged_cells(grid)
    assert merged.where(F.col("n") == 50).count() == 1


def test_thin_dimension_splits(spark):
    """One dimension is one cell wide; splits still number the children."""
    coords = [[(i % 5) * 200.0, (i % 10) * 0.0001] for i in range(400)]
    pts = make_points(spark, coords)
    grid = G.adaptive_grid(pts, 4, 2)
    assert grid.spec.parts[1] == 1
    assert grid.n_splits > 0
    per = grid.points.groupBy("cell_key").agg(F.count("*").alias("n"),
                                              F.countDistinct("coords").alias("nd")).collect()
    assert sum(r["n"] for r in per) == 400
    assert all(r["n"] <= 4 or r["nd"] == 1 for r in per)
    assert len(per) == 10


def test_mostly_empty_grid_caps_quota(spark):
    """Average below one point per cell; quota capped by distinct points."""
    import random
    rng = random.Random(1)
    coords = ([[rng.uniform(0, 0.01) for _ in range(4)] for _ in range(30)]
              + [[100 + rng.uniform(0, 0.01) for _ in range(4)] for _ in range(30)])
    pts = make_points(spark, coords)
    grid = G.adaptive_grid(pts, 5, 4)
    assert grid.avg_per_cell < 1
    merged = SM.merged_cells(grid)
    q = SM.cell_quota(merged, grid.avg_per_cell)
    assert q.where(F.col("k") > F.col("n_distinct")).count() == 0
    sample = SM.cell_pam(merged, 4, grid.avg_per_cell)
    assert sample.count() == q.agg(F.sum("k")).first()[0]


def test_constant_dimension_is_left_out(spark):
    """(i, 7) has zero volume in 2-d; grid on the varying dimension."""
    pts = make_points(spark, [[float(i), 7.0] for i in range(50)])
    spec = G.grid_spec(pts, 5, 2)
    assert spec.active == [True, False]
    assert spec.side == pytest.approx(5.0 * 49 / 50)
    grid = G.adaptive_grid(pts, 5, 2, spec=spec)
    assert grid.points.count() == 50


def test_uniform_cells_cover_every_number(spark):
    pts = PART.load(spark, SF01)
    spec = G.grid_spec(pts, 20, 2)
    cells = G.uniform_cells(spark, spec)
    assert cells.count() == spec.n_uniform
    assert cells.agg(F.countDistinct("cell")).first()[0] == spec.n_uniform


def test_high_dimension_grid_does_not_enumerate_cells(spark):
    """64-d unit vectors give ~2^57 uniform cells; only occupied ones exist."""
    from tessera.plans.fixtures import EMBED
    pts = EMBED.load(spark, "/root/testdata/sf0.001")
    grid = G.adaptive_grid(pts, 20, 64)
    assert grid.spec.n_uniform > 2 ** 40
    assert grid.points.count() == 500
    assert grid.points.select("cell_key").distinct().count() <= 500
    assert grid.avg_per_cell < 1e-6


def test_a_run_in_100_dimensions(spark):
    """Cell numbers beyond 63 bits: cells are keyed by their indices, and the
    quota on occupied cells still samples."""
    import random
    from tessera.plans.run import cluster
    rng = random.Random(3)
    centers = [[0.0] * 100, [1.0] * 100] + [[float(rng.randrange(2)) for _ in range(100)] for _ in range(2)]
    coords = [[abs(v - 1e-3 * rng.random()) for v in rng.choice(centers)] for _ in range(300)]
    pts = make_points(spark, coords)
    spec = G.grid_spec(pts, 100, 100)
    assert not spec.numbered
    res = cluster(pts, 3, 100, 1, avg_basis="occupied")
    m = {(p, n): v for p, _, n, v in res.metric_rows}
    assert m[("sample", "sample_size")] < 30
    assert res.assignments.count() == 300 and len(res.center_list) == 3


def test_all_leaves_with_empty_children(spark):
    pts = PART.load(spark, SF01)
    grid = G.adaptive_grid(pts, 20, 2)
    cells = G.adaptive_cells(grid, empty=True)
    assert cells.count() == grid.n_cells
    assert cells.agg(F.sum("n")).first()[0] == grid.spec.n
    assert cells.where("n > 0").count() == G.adaptive_cells(grid).count()


def _bytes_in(folder) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_points_are_not_rewritten_and_scans_are_few(spark, tmp_path, monkeypatch):
    """What a split writes are counts of cells; its scans grow with the logarithm of the levels."""
    pts = EVENTS.load(spark, "/root/testdata/sf0.1")
    scans = []
    counted = G._level_counts
    monkeypatch.setattr(G, "_level_counts", lambda *a: scans.append(a[3:5]) or counted(*a))
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        grid = G.adaptive_grid(pts, 200, 2)
        written = _bytes_in(tmp_path)
        sizes = grid.points.groupBy("cell_key").count()
        assert sizes.agg(F.sum("count"), F.max("count")).first() == (grid.spec.n, 200)
    finally:
        if before:
            spark._jsc.sc().setCheckpointDir(os.path.dirname(before))
    assert grid.levels == 3 and written < 1.5 * grid.spec.n * 32
    assert scans == [(0, 0), (1, 2), (3, 6), (7, 14)][:len(scans)] and len(scans) <= 2 + math.log2(grid.levels)


@pytest.mark.parametrize("at_once,broadcast_bytes", [(1, G.BROADCAST_BYTES), (2, G.BROADCAST_BYTES), (8, 0)])
def test_cut_plans_and_shuffled_directories_give_the_same_leaves(spark, monkeypatch, at_once, broadcast_bytes):
    import random
    rng = random.Random(5)
    pts = make_points(spark, [[rng.random() ** 6 * 100, rng.random() ** 6 * 100] for _ in range(800)])
    want = {r["point_id"]: (r["cell_key"], r["depth"], list(r["a"])) for r in G.adaptive_grid(pts, 5, 2).points.collect()}
    monkeypatch.setattr(G, "LEVELS_AT_ONCE", at_once)
    grid = G.adaptive_grid(pts, 5, 2, broadcast_bytes=broadcast_bytes)
    got = grid.points.collect()
    assert grid.levels > 3 and len(got) == len(want)
    assert {r["point_id"]: (r["cell_key"], r["depth"], list(r["a"])) for r in got} == want
    leaves = {(r["cell_key"], r["depth"]): r["n"] for r in grid.cells.collect()}
    counts = {}
    for key, depth, _ in want.values():
        counts[key, depth] = counts.get((key, depth), 0) + 1
    assert leaves == counts
