"""Density-aware sample: k-medoids inside every grid cell (A1-A3, A5).

Plan: merge equal coordinates inside each leaf cell (``groupBy(cell_key,
coords)`` with partial aggregation, so a hot group of copies is combined
map-side), give every cell its quota ``k_c`` (A1), and run a swap-based
k-medoids per cell (A3) with a grouped map over hash buckets of cells. A
leaf holds at most ``tau`` distinct points (the adaptive grid guarantees
it); a task holds its cells' points and scores candidates in chunks, so its
memory grows with ``tau``, not with its square.
The medoids of all cells are the sample (A5).

Randomness is a seeded rank, ``pmod(pmod(id, 2^31) * 2654435761 + seed,
2^32)``, so the same seed gives the same sample on any partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import coords_matrix, cross_distances
from tessera.operators.grid import AdaptiveGrid
from tessera.session import checkpoint

# fixed values: the multiplicative hash of the seeded rank
RANK_MULTIPLIER = 2654435761
RANK_MODULUS = 2 ** 32
ID_MODULUS = 2 ** 31

# costs within this relative distance of each other are ties (broken by
# rank), and a swap must beat the current cost by more than it: sums that
# are equal in exact arithmetic differ in the last bits with summation
# order, which varies with partitioning
TIE_RTOL = 1e-9

# doubles in one numpy distance buffer inside a task
CHUNK_DOUBLES = 1_000_000


def seeded_rank(point_id: Column | str, seed: int = 0) -> Column:
    """Seeded pseudo-random order key of a point id (ties broken by id)."""
    pid = F.col(point_id) if isinstance(point_id, str) else point_id
    base = F.pmod(pid, F.lit(ID_MODULUS).cast("bigint"))
    return F.pmod(base * F.lit(RANK_MULTIPLIER).cast("bigint") + F.lit(int(seed)).cast("bigint"),
                  F.lit(RANK_MODULUS).cast("bigint"))


def seeded_rank_np(ids: np.ndarray, seed: int = 0) -> np.ndarray:
    ids = np.asarray(ids, dtype=np.int64)
    base = np.mod(ids, ID_MODULUS)
    return np.mod(base * RANK_MULTIPLIER + seed, RANK_MODULUS)


def merged_cells(grid: AdaptiveGrid, seed: int = 0) -> DataFrame:
    """Distinct points per leaf cell: ``cell_key, coords, n, weight, point_id,
    rank``. ``point_id`` is the lowest id among the copies."""
    g = grid.points.groupBy("cell_key", "coords").agg(
        F.count("*").alias("n"), F.sum("weight").alias("weight"),
        F.min("point_id").alias("point_id"))
    return g.withColumn("rank", seeded_rank("point_id", seed))


def quota_of(cell_n, n_distinct, avg_per_cell: float):
    """``min(ceil(cell_n / avg), n_distinct)`` (A1, D6) for Columns or numbers."""
    if isinstance(cell_n, Column):
        return F.least(F.ceil(cell_n / F.lit(float(avg_per_cell))).cast("bigint"), n_distinct)
    return min(math.ceil(cell_n / float(avg_per_cell)), int(n_distinct))


def cell_quota(merged: DataFrame, avg_per_cell: float) -> DataFrame:
    """``cell_key, cell_n, n_distinct, k`` (A1): ``cell_n`` counts copies,
    ``n_distinct`` the merged rows."""
    per = merged.groupBy("cell_key").agg(F.sum("n").alias("cell_n"),
                                         F.count("*").alias("n_distinct"))
    return per.withColumn("k", quota_of(F.col("cell_n"), F.col("n_distinct"), avg_per_cell))


def initial_medoids(merged: DataFrame, quota: DataFrame) -> DataFrame:
    """First ``k`` distinct points of each cell in rank order (A2)."""
    from pyspark.sql import Window
    w = Window.partitionBy("cell_key").orderBy("rank", "point_id")
    return (merged.join(quota.select("cell_key", "k"), "cell_key")
            .withColumn("slot", (F.row_number().over(w) - 1).cast("int"))
            .where(F.col("slot") < F.col("k"))
            .drop("k"))


# ----------------------------------------------------------------- numpy PAM


def nearest_two(DM: np.ndarray):
    """Per row of a point-by-medoid distance block: nearest slot (lowest on
    ties), its distance, and the distance to the nearest other medoid."""
    m, k = DM.shape
    m1 = np.argmin(DM, axis=1)
    d1 = DM[np.arange(m), m1]
    if k > 1:
        DM2 = DM.copy()
        DM2[np.arange(m), m1] = np.inf
        d2 = DM2.min(axis=1)
    else:
        d2 = np.full(m, np.inf)
    return m1, d1, d2


class SwapScorer:
    """Swap costs of candidates against fixed scored points and medoids.

    The cost of slot ``i`` swapped for candidate ``c`` is the weighted sum of
    ``min(rest_i(p), |p - c|)``, ``rest_i`` being the distance to the nearest
    other medoid: ``d2`` for points whose nearest medoid is slot ``i``, else
    ``d1``. So a candidate changes a point's term only where it is nearer than
    ``d2``: for a chunk of candidates, points whose distance to the chunk's
    bounding box is ``d2`` or more add what they add anyway, and no distance
    is computed. Candidates are sorted along their widest dimension so that
    chunks are compact. Points are sorted by nearest slot, so each slot's
    points are a slice. Memory is ``CHUNK_DOUBLES`` per buffer.
    """

    def __init__(self, P: np.ndarray, w: np.ndarray, medoids: np.ndarray):
        m1, d1, d2 = nearest_two(cross_distances(P, medoids))
        order = np.argsort(m1, kind="stable")
        self.k = medoids.shape[0]
        self.P, self.w = P[order], w[order]
        self.d1, self.d2 = d1[order], d2[order]
        self.bounds = np.searchsorted(m1[order], np.arange(self.k + 1))
        if self.k > 1:
            self.base = float(self.w @ self.d1)
            gap = self.w * (self.d2 - self.d1)
            self.own = [float(gap[a:b].sum()) for a, b in zip(self.bounds[:-1], self.bounds[1:])]

    def table(self, C: np.ndarray) -> np.ndarray:
        """``k x len(C)`` swap costs."""
        out = np.empty((self.k, len(C)))
        if not len(C) or not len(self.P):
            out[:] = 0.0
            return out
        order = np.argsort(C[:, int(np.argmax(np.ptp(C, axis=0)))], kind="stable")
        chunk = max(1, CHUNK_DOUBLES // len(self.P))
        for s in range(0, len(C), chunk):
            at = order[s:s + chunk]
            c = C[at]
            if self.k == 1:
                out[0, at] = self.w @ cross_distances(self.P, c)
                continue
            away = np.maximum(0.0, np.maximum(c.min(axis=0) - self.P, self.P - c.max(axis=0)))
            near = np.flatnonzero(np.sqrt((away * away).sum(axis=1)) < self.d2)
            bounds = np.searchsorted(near, self.bounds)
            D = cross_distances(self.P[near], c)
            w, d1, d2 = self.w[near], self.d1[near, None], self.d2[near, None]
            base = self.base + w @ np.minimum(D - d1, 0.0)
            for i in range(self.k):
                a, b = bounds[i], bounds[i + 1]
                out[i, at] = base + self.own[i]
                if b > a:
                    out[i, at] += w[a:b] @ (np.clip(D[a:b], d1[a:b], d2[a:b]) - d2[a:b])
        return out


def pam_points(X: np.ndarray, w: np.ndarray, k: int, max_sweeps: int | None = None):
    """Swap-based k-medoids on points, rows in rank order.

    Start from rows ``0..k-1``. A sweep visits slot 0..k-1; for each it finds
    the non-medoid whose swap gives the lowest weighted cost (first in rank
    order among costs within ``TIE_RTOL`` of the lowest) and takes it only
    when cheaper than the current cost by more than ``TIE_RTOL``. Sweeps repeat
    until the medoid set does not change. One cost table serves the slots
    until a swap changes the set. Candidates are scored in chunks, so memory
    grows with the points, not with their square. Returns (medoid rows, cost).
    """
    k = min(k, len(X))
    med = list(range(k))
    sweeps, table = 0, None
    while True:
        before = set(med)
        for i in range(k):
            if table is None:
                table = SwapScorer(X, w, X[med]).table(X)
            costs = table[i].copy()
            current = float(costs[med[i]])
            costs[med] = np.inf
            low = float(costs.min())
            if not np.isfinite(low):
                continue
            j = int(np.argmax(costs <= low + TIE_RTOL * abs(low)))
            if costs[j] < current - TIE_RTOL * abs(current):
                med[i] = j
                if k > 1:       # with one medoid the table holds whatever it is
                    table = None
        sweeps += 1
        if set(med) == before or (max_sweeps is not None and sweeps >= max_sweeps):
            break
    nearest = nearest_two(cross_distances(X, X[med]))[1]
    return med, float(np.dot(w, nearest))


_PAM_COLS = ["cell_key", "point_id", "rank", "n", "weight", "coords"]


def _pam_buckets(d: int, max_sweeps: int | None, quota_one: bool, avg_per_cell: float):
    """applyInArrow body: every cell of one hash bucket, cell by cell."""

    def fn(t: pa.Table) -> pa.Table:
        t = t.select(_PAM_COLS).sort_by([("cell_key", "ascending"), ("rank", "ascending"), ("point_id", "ascending")])
        keys = t.column("cell_key").to_numpy()
        X = coords_matrix(t.column("coords"), d)
        counts = t.column("n").to_numpy()
        w = counts.astype(np.float64)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        rows, slots, costs = [], [], []
        for a, b in zip(starts, ends):
            k = 1 if quota_one else quota_of(int(counts[a:b].sum()), b - a, avg_per_cell)
            med, cost = pam_points(X[a:b], w[a:b], k, max_sweeps)
            rows.extend(int(a + j) for j in med)
            slots.extend(range(len(med)))
            costs.extend([cost] * len(med))
        out = t.take(pa.array(rows, pa.int64()))
        return (out.append_column("slot", pa.array(slots, pa.int32()))
                .append_column("cell_cost", pa.array(costs, pa.float64())))

    return fn


# merged rows per PAM task (cells are whole inside a task; each cell holds at
# most tau distinct points, and is scored in chunks)
ROWS_PER_TASK = 100_000


def cell_pam(merged: DataFrame, d: int, avg_per_cell: float, max_sweeps: int | None = None,
             quota_one: bool = False, n_rows: int | None = None,
             rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """k-medoids inside every cell (A3): ``cell_key, slot, point_id, rank,
    n, weight, coords, cell_cost``, one row per medoid.

    Cells are hashed into buckets of about ``rows_per_task`` merged rows
    (``n_rows`` bounds the merged row count; counted when not given), and
    one grouped-map call handles a whole bucket, cell by cell, so the cost
    per cell is a numpy slice rather than a pandas group. ``quota_one``
    runs the 1-medoid search in every cell instead of the density quota.
    """
    if n_rows is None:
        n_rows = merged.count()
    par = merged.sparkSession.sparkContext.defaultParallelism
    buckets = max(par, -(-int(n_rows) // rows_per_task))
    flat = merged.select(F.pmod(F.xxhash64("cell_key"), F.lit(buckets)).alias("_b"), *_PAM_COLS)
    schema = ("cell_key STRING, point_id BIGINT, rank BIGINT, n BIGINT, weight DOUBLE, coords ARRAY<DOUBLE>, "
              "slot INT, cell_cost DOUBLE")
    res = flat.groupBy("_b").applyInArrow(_pam_buckets(d, max_sweeps, quota_one, avg_per_cell), schema)
    return res.select("cell_key", "slot", "point_id", "rank", "n", "weight", "coords", "cell_cost")


def grid_sample(grid: AdaptiveGrid, seed: int = 0, max_sweeps: int | None = None,
                avg_basis: str = "all") -> DataFrame:
    """The sample: medoids of all cells (A5), ``point_id, coords, rank, cell_key, slot``.
    ``avg_basis`` is the average the quota divides by (``AdaptiveGrid.average``)."""
    merged = checkpoint(merged_cells(grid, seed))
    return cell_pam(merged, grid.spec.d, grid.average(avg_basis), max_sweeps)
