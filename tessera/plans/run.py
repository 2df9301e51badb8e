"""The whole clustering run (M1): grid, sample, phase 1, phase 2.

    points -> bounds (1 job) -> adaptive grid (a directory of split cells from
    counts, several levels a scan; a point's leaf is a projection) -> distinct
    points per cell (partial aggregation, checkpointed) -> per-cell k-medoids
    (grouped map over buckets of cells; sample checkpointed) -> slot sweeps over
    the sample (a narrow job a round) -> phase 2: ``iterations`` x (assign, one
    k-row aggregate per pass; cost with the first pass).

Only k centers, bounds, scalar counts, the boxes of the sample's blocks and, per
scoring round, the few candidates that can win a slot reach the driver (a
packed sample of at most 32 MB passes through it to be broadcast). Plans keep a bounded size
and lineage does not grow across iterations. The input is read for the bounds, once
per stage of levels, by the copy merge and by the assignment.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tessera.operators import assign as A
from tessera.operators import grid as G
from tessera.operators import refine as W
from tessera.operators import sample as SM
from tessera.operators import search as SR
from tessera.session import checkpoint
from tessera.sources.points import point_dimension, write_result

METRICS_SCHEMA = "phase STRING, iteration INT, metric STRING, value DOUBLE"


@dataclass
class ClusterResult:
    centers: DataFrame            # center_id INT, coords ARRAY<DOUBLE>, kind STRING
    assignments: DataFrame        # point_id BIGINT, center_id INT, distance DOUBLE (lazy)
    metrics: DataFrame            # run_metrics rows
    center_list: list = field(default_factory=list)
    metric_rows: list = field(default_factory=list)
    timings: dict = field(default_factory=dict)


def cluster(points: DataFrame, k: int, tau: int, iterations: int, seed: int = 0,
            epsilon: float = W.EPSILON, max_passes: int | None = None,
            max_sweeps: int | None = None, max_depth: int = G.MAX_DEPTH,
            avg_basis: str = "all",
            block_rows: int | None = None, method: str = "newton") -> ClusterResult:
    """Cluster ``points`` (``point_id, coords, weight``) around ``k`` centers.

    ``avg_basis`` is the average that the per-cell quota divides by: ``all``
    cells, or the ``occupied`` ones. In more than a few dimensions most cells
    are empty, the average over all is far below one, and every distinct
    point would be sampled; use ``occupied`` there.
    """
    spark = points.sparkSession
    t = {}
    t0 = time.time()
    pts = points.select("point_id", "coords", "weight")
    d = point_dimension(pts)
    metrics = []

    def metric(phase, it, name, value):
        metrics.append((phase, it, name, float(value)))

    # grid
    grid = G.adaptive_grid(pts, tau, d, max_depth=max_depth)
    spec = grid.spec
    metric("grid", 0, "n", spec.n)
    metric("grid", 0, "k", k)
    metric("grid", 0, "tau", tau)
    metric("grid", 0, "uniform_cells", spec.n_uniform)
    metric("grid", 0, "uniform_avg_per_cell", spec.n / spec.n_uniform)
    metric("grid", 0, "adaptive_cells", grid.n_cells)
    metric("grid", 0, "levels", grid.levels)
    t["grid"] = time.time() - t0

    # sample: distinct points per cell, k-medoids inside each cell
    t1 = time.time()
    merged = checkpoint(SM.merged_cells(grid, seed))
    sample = checkpoint(SM.cell_pam(merged, d, grid.average(avg_basis), max_sweeps)
                        .select("point_id", "coords", "rank", "cell_key", "slot"))
    s = sample.count()
    metric("sample", 0, "sample_size", s)
    t["sample"] = time.time() - t1

    # phase 1
    t2 = time.time()
    res = SR.sample_medoids(sample, k, d, max_sweeps=max_sweeps, block_rows=block_rows, n=s)
    centers = [(j, [float(v) for v in res.medoids[j]]) for j in range(k)]
    metric("phase1", 0, "sample_cost", res.cost)
    metric("phase1", 0, "sweeps", res.sweeps)
    t["phase1"] = time.time() - t2

    # phase 2; the cost of a center set comes with the first Weiszfeld pass
    # of the refinement that starts from it (same rows, same assignment), so
    # only the final centers need a cost job of their own
    t3 = time.time()
    kind = "medoid"
    trace = []
    for it in range(iterations):
        centers, mres = W.refine_once(merged, centers, d, epsilon, max_passes, method)
        trace.append((it, mres.start_cost, max(mres.passes.values()) if mres.passes else 0))
        kind = "median"
    final_cost = A.clustering_cost_value(merged, centers, multiplicity="n")
    costs = [c for _, c, _ in trace] + [final_cost]
    metric("phase1", 0, "cost", costs[0])
    for (it, _, passes), cost in zip(trace, costs[1:]):
        metric("phase2", it, "passes", passes)
        metric("phase2", it, "cost", cost)
    t["phase2"] = time.time() - t3

    center_df = spark.createDataFrame([(j, c, kind) for j, c in centers],
                                      "center_id INT, coords ARRAY<DOUBLE>, kind STRING")
    assignments = A.assign_nearest(grid.points.select("point_id", "coords"), centers)
    metrics_df = spark.createDataFrame(metrics, METRICS_SCHEMA)
    t["total"] = time.time() - t0
    return ClusterResult(center_df, assignments, metrics_df, centers, metrics, t)


def write_cluster_result(result: ClusterResult, path: str) -> None:
    """Write centers, assignments and metrics as parquet under ``path``."""
    write_result(result.centers, f"{path}/centers")
    write_result(result.assignments, f"{path}/assignments")
    write_result(result.metrics, f"{path}/run_metrics")


def cost_trace(points: DataFrame, centers: list, iterations: int, epsilon: float = W.EPSILON,
               max_passes: int | None = None, method: str = "newton") -> DataFrame:
    """Cost with the given centers, then after each refinement (E3/W9):
    ``phase, iteration, cost``."""
    spark = points.sparkSession
    d = len(centers[0][1])
    merged = checkpoint(W.merge_duplicates(points))
    costs = []
    for _ in range(iterations):
        centers, mres = W.refine_once(merged, centers, d, epsilon, max_passes, method)
        costs.append(mres.start_cost)       # cost of the centers this refinement started from
    costs.append(A.clustering_cost_value(merged, centers, multiplicity="n"))
    rows = [("start", 0, costs[0])] + [("phase2", it, c) for it, c in enumerate(costs[1:])]
    return spark.createDataFrame(rows, "phase STRING, iteration INT, cost DOUBLE")
