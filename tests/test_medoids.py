"""Per-cell PAM and the sample search against a plain-Python slot sweep."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01, make_points
from tessera.operators import grid as G
from tessera.operators import sample as SM
from tessera.operators import search as SR
from tessera.plans.fixtures import PART
from tessera.session import shared_dir


TOL = SM.TIE_RTOL


def _dist(a, b):
    return math.sqrt(sum((a[i] - b[i]) ** 2 for i in range(len(a))))


def pam_plain(X, w, k):
    """Literal slot sweep: rows are in rank order; start at rows 0..k-1;
    per slot take the cheapest non-medoid if strictly cheaper; repeat
    until the set is stable."""
    m = len(X)

    def cost(med):
        return sum(w[p] * min(_dist(X[p], X[j]) for j in med) for p in range(m))

    med = list(range(k))
    while True:
        old = set(med)
        for i in range(k):
            cur = cost(med)
            orig, cands = med[i], []
            for j in range(m):
                if j in med:
                    continue
                med[i] = j
                cands.append((cost(med), j))
                med[i] = orig
            if not cands:
                continue
            low = min(c for c, _ in cands)
            # first in rank order among the ties
            best, bestc = next((j, c) for c, j in cands if c <= low + TOL * abs(low))
            if bestc < cur - TOL * abs(cur):
                med[i] = best
        if set(med) == old:
            return med, cost(med)


def test_numpy_sweep_equals_plain_sweep():
    rng = random.Random(7)
    for trial in range(6):
        m = rng.randint(5, 25)
        X = [[rng.uniform(0, 10), rng.uniform(0, 10)] for _ in range(m)]
        w = [float(rng.randint(1, 3)) for _ in range(m)]
        k = rng.randint(1, min(4, m))
        med, cost = SM.pam_points(np.array(X), np.array(w), k)
        pmed, pcost = pam_plain(X, w, k)
        assert med == pmed
        assert cost == pytest.approx(pcost, rel=1e-12)


def test_cell_pam_matches_plain_sweep_on_part(spark):
    pts = PART.load(spark, SF01)
    grid = G.adaptive_grid(pts, 20, 2)
    merged = SM.merged_cells(grid)
    res = SM.cell_pam(merged, 2, grid.avg_per_cell).collect()
    got = {}
    for r in res:
        got.setdefault(r["cell_key"], {})[r["slot"]] = r["point_id"]
    rows = merged.select("cell_key", "point_id", "rank", "n", "coords").collect()
    cells = {}
    for r in rows:
        cells.setdefault(r["cell_key"], []).append(r)
    avg = grid.avg_per_cell
    assert set(cells) == set(got)
    for key, members in cells.items():
        members.sort(key=lambda r: (r["rank"], r["point_id"]))
        cell_n = sum(r["n"] for r in members)
        k = min(math.ceil(cell_n / avg), len(members))
        med, _ = pam_plain([list(r["coords"]) for r in members], [float(r["n"]) for r in members], k)
        assert [members[j]["point_id"] for j in med] == [got[key][s] for s in range(k)], key
    # sample size matches the survey's measurement for this table and tau
    assert len(res) == 359


def test_sample_search_matches_plain_sweep(spark):
    pts = PART.load(spark, SF001).withColumn("rank", SM.seeded_rank("point_id", 0))
    res = SR.sample_medoids(pts, 3, 2)
    rows = pts.orderBy("rank", "point_id").collect()
    X = [list(r["coords"]) for r in rows]
    med, cost = pam_plain(X, [1.0] * len(X), 3)
    assert res.medoid_ids == [rows[j]["point_id"] for j in med]
    assert res.cost == pytest.approx(cost, rel=1e-9)


def test_search_with_many_blocks_equals_one_block(spark, monkeypatch):
    pts = PART.load(spark, SF001).withColumn("rank", SM.seeded_rank("point_id", 0))
    monkeypatch.setattr(SR, "PAIRS_PER_CORE", 0)
    one = SR.sample_medoids(pts, 3, 2)
    many = SR.sample_medoids(pts, 3, 2, block_rows=37)
    monkeypatch.setattr(SR, "ADD_AT_ONCE", 2)      # tables added in several steps
    steps = SR.sample_medoids(pts, 3, 2, block_rows=37)
    assert one.medoid_ids == many.medoid_ids == steps.medoid_ids
    assert one.cost == pytest.approx(many.cost, rel=1e-9) and many.cost == pytest.approx(steps.cost, rel=1e-9)


def test_scorer_equals_plain_costs_with_many_medoids():
    """Points near two medoids are skipped by chunk; the sums stay the same."""
    rng = np.random.default_rng(2)
    X, w = rng.uniform(0, 100, (300, 2)), rng.integers(1, 4, 300).astype(float)
    for k in (1, 2, 40):
        med = list(range(k))
        got = SM.SwapScorer(X, w, X[med]).table(X)
        D = SM.cross_distances(X, X)
        for i in range(k):
            rest = np.min(np.delete(D[:, med], i, axis=1), axis=1, initial=np.inf)
            want = (w[:, None] * np.minimum(rest[:, None], D)).sum(axis=0)
            assert np.allclose(got[i], want, rtol=1e-12)


@pytest.mark.parametrize("k", [1, 2, 40])
def test_blocks_far_from_the_candidates_are_skipped_exactly(spark, monkeypatch, k):
    """Swap costs of the broadcast and of the joined form equal plain sums; far pairs are not computed."""
    rng = np.random.default_rng(6)
    X = rng.uniform(0, 100, (1500, 2))
    X[100:160] = X[0]
    pts = make_points(spark, X.tolist()).withColumn("rank", SM.seeded_rank("point_id", 0))
    M = X[200:200 + k]
    D, DM = SM.cross_distances(X, X), SM.cross_distances(X, M)
    want = np.array([np.minimum(np.min(np.delete(DM, i, axis=1), axis=1, initial=np.inf)[:, None], D).sum(axis=0) for i in range(k)])
    monkeypatch.setattr(SR, "PIECE_ROWS", 100)
    for limit, at_once in ((SR.BROADCAST_BYTES, 64), (0, 64), (0, 3)):
        monkeypatch.setattr(SR, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(SR, "ADD_AT_ONCE", at_once)
        blocks = SR.block_pairs(pts, 2, block_rows=25)
        assert (blocks.whole is None) == (limit == 0) and blocks.sizes.max() <= 25 and blocks.sizes.sum() == 1500
        rows = SR.swap_costs(blocks, M).collect()
        got = np.empty((k, 1500))
        for r in rows:
            got[:, r["point_id"]] = [r[f"cost_{i}"] for i in range(k)]
        assert len(rows) == 1500 and np.allclose(got, want, rtol=1e-10)
        bound = SR.reach(blocks, M)
        pairs = sum(len(SR.near_blocks(blocks, b, bound)) for b in range(len(blocks.ids)))
        assert {1: pairs == len(blocks.ids) ** 2, 2: pairs <= len(blocks.ids) ** 2, 40: pairs < 0.6 * len(blocks.ids) ** 2}[k]
    near = X[np.argsort(SR.morton_keys(X, X.min(axis=0), X.max(axis=0)))]
    points = SR.Points(near, M)
    points.changes(near[:90])
    assert points.distances < 0.3 * 90 * 1500 if k == 40 else points.distances > 0


def test_a_larger_sample_is_not_shuffled_by_pairs_of_blocks(spark, monkeypatch):
    """Beyond one broadcast the search leaves its blocks, not one copy a pair, and the same medoids."""
    pts = PART.load(spark, SF001).withColumn("rank", SM.seeded_rank("point_id", 0))
    want = SR.sample_medoids(pts, 3, 2)
    monkeypatch.setattr(SR, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(SR, "BOUND_FROM", 0)
    monkeypatch.setattr(SR, "ADD_AT_ONCE", 3)
    blocks = SR.block_pairs(pts, 2, block_rows=20)
    assert len(blocks.parts) == -(-len(blocks.ids) // 3) and sorted(np.concatenate([at for _, at in blocks.parts])) == list(range(len(blocks.ids)))
    med = SR.initial_global(pts, 3)
    plan = SR.swap_costs(blocks, SR.medoid_coords(pts, med))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = SR.sample_medoids(pts, 3, 2, block_rows=20)
    assert got.medoid_ids == want.medoid_ids and got.cost == pytest.approx(want.cost, rel=1e-9) and got.sweeps == want.sweeps
    assert not any(x.startswith("bounds") for x in set(os.listdir(folder)) - before)


def test_row_statistics_of_both_forms_agree(spark, monkeypatch):
    pts = PART.load(spark, SF001)
    few = {r["point_id"]: r for r in SR.row_distance_stats(pts, 2).collect()}
    monkeypatch.setattr(SR, "BROADCAST_BYTES", 0)
    many = SR.row_distance_stats(pts, 2, block_rows=30).collect()
    assert len(many) == len(few)
    for r in many:
        assert r["dist_sum"] == pytest.approx(few[r["point_id"]]["dist_sum"], rel=1e-9) and r["dist_min"] == few[r["point_id"]]["dist_min"]


def test_a_cell_of_any_size_is_swept(spark, monkeypatch):
    """tau above the number of points: one big cell, in small chunks."""
    rng = np.random.default_rng(4)
    X, w = rng.normal(size=(3000, 2)), np.ones(3000)
    small = SM.pam_points(X, w, 2, max_sweeps=1)
    monkeypatch.setattr(SM, "CHUNK_DOUBLES", 20_000)
    assert SM.pam_points(X, w, 2, max_sweeps=1)[0] == small[0]


def test_many_ties_send_few_rows(spark):
    """All points of a circle tie for one slot; a block sends the one that can win."""
    ang = np.arange(400) * 2 * np.pi / 400
    pts = make_points(spark, np.c_[np.cos(ang), np.sin(ang)].tolist()).withColumn("rank", SM.seeded_rank("point_id", 0))
    med = SR.initial_global(pts, 1)
    cur, best = SR.best_swaps(SR.block_pairs(pts, 2), SR.medoid_coords(pts, med), med, [0])[0]
    order = [r["point_id"] for r in pts.orderBy("rank", "point_id").collect()]
    assert best[0] == order[1] and best[1] == pytest.approx(cur, rel=1e-9)


def test_phase1_beats_random_start(spark):
    """D1 regression: real distances, so the search improves on its start."""
    rng = random.Random(3)
    blobs = [(0, 0), (10, 10), (0, 20)]
    coords = [[cx + rng.gauss(0, 1), cy + rng.gauss(0, 1)] for cx, cy in blobs for _ in range(20)]
    pts = make_points(spark, coords).withColumn("rank", SM.seeded_rank("point_id", 0))
    start = SR.initial_global(pts, 3)
    M0 = SR.medoid_coords(pts, start)
    start_cost = SR.set_cost(pts, M0).first()["cost"]
    res = SR.sample_medoids(pts, 3, 2)
    assert res.cost < start_cost
    # one medoid per blob
    lab = sorted(int(i) // 20 for i in res.medoid_ids)
    assert lab == [0, 1, 2]


def test_k_above_sample_size_is_an_error(spark):
    """D10."""
    pts = make_points(spark, [[0, 0], [1, 1], [2, 2]]).withColumn("rank", F.col("point_id"))
    with pytest.raises(ValueError):
        SR.sample_medoids(pts, 5, 2)


def test_sweeps_never_raise_cost(spark):
    pts = PART.load(spark, SF001).withColumn("rank", SM.seeded_rank("point_id", 1))
    costs = []
    for sweeps in (1, 2, 3):
        costs.append(SR.sample_medoids(pts, 4, 2, max_sweeps=sweeps).cost)
    assert costs[0] >= costs[1] - 1e-9 >= costs[2] - 2e-9


def test_rank_is_the_same_in_numpy_and_spark(spark):
    ids = list(range(0, 5000, 7)) + [2 ** 31 + 5, 2 ** 40 + 3]
    df = spark.createDataFrame([(i,) for i in ids], "point_id BIGINT")
    got = [r["r"] for r in df.select(SM.seeded_rank("point_id", 11).alias("r")).collect()]
    assert got == list(SM.seeded_rank_np(np.array(ids), 11))
