"""Nearest-center assignment and clustering cost.

Centers are few (``k`` rows) and enter the plan as literals, so assignment
is a narrow projection: no join, no shuffle. For small ``k * d`` it is one
unrolled ``least(struct(distance, id), ...)`` expression inside whole-stage
codegen. Past about 48 terms the generated code stops compiling well
(measured: 600k 2-d rows, k = 50 took 5.5 s unrolled; 100k 64-d rows, k = 10
took 0.9 s with higher-order functions), so larger ``k * d`` uses an
Arrow UDF that does the same arithmetic in numpy on the batch's matrix,
summing squares dimension by dimension in the same
order and breaking ties to the lowest center id. Many centers are indexed (``CenterIndex``): groups
around a few of them, passed over where the triangle inequality says that none can be nearest.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import coords_matrix, cross_distances, distance

# at most this many k*d terms go into one unrolled least(...) expression
UNROLL_TERMS = 48
# centers from which an index is worth its groups
INDEX_CENTERS = 64
# coordinates beyond this may overflow when squared: the bounds don't hold there
SAFE = 1e150
# relative slack of the bounds against rounding
SLACK = 1e-9

CenterList = list[tuple[int, list[float]]]


def centers_list(centers: DataFrame | Sequence) -> CenterList:
    """Normalize centers to ``[(center_id, coords)]`` sorted by id.

    A DataFrame must have ``center_id`` and ``coords``. Centers are the
    method's ``k`` rows, which the driver holds whatever their source.
    """
    if isinstance(centers, DataFrame):
        rows = centers.select("center_id", "coords").collect()
        out = [(int(r["center_id"]), [float(v) for v in r["coords"]]) for r in rows]
    else:
        out = []
        for j, c in enumerate(centers):
            if isinstance(c, tuple) and len(c) == 2 and hasattr(c[1], "__len__"):
                out.append((int(c[0]), [float(v) for v in c[1]]))
            else:
                out.append((j, [float(v) for v in c]))
    out.sort(key=lambda t: t[0])
    if not out:
        raise ValueError("no centers")
    return out


class CenterIndex:
    """Nearest of many centers, the first of equals.

    About ``sqrt(k)`` centers far from each other are pivots; every center belongs to its nearest pivot. A point
    measures the pivots, then the centers around its nearest one, which bounds its distance; of
    the other groups only those are measured whose pivot is no further than that plus the group's radius.
    """

    def __init__(self, C: np.ndarray):
        self.C = C
        self.distances = 0         # how many were computed
        self.bounded = len(C) >= INDEX_CENTERS and bool(np.all(np.abs(C) < SAFE))
        if not self.bounded:
            return
        pivots, far = [0], cross_distances(C, C[:1])[:, 0]
        while len(pivots) ** 2 < len(C) and far.max() > 0:
            pivots.append(int(far.argmax()))
            far = np.minimum(far, cross_distances(C, C[pivots[-1:]])[:, 0])
        self.pivots = C[pivots]
        to = cross_distances(C, self.pivots)
        own = to.argmin(axis=1)
        self.groups = [np.flatnonzero(own == j) for j in range(len(pivots))]
        self.radius = np.array([to[g, j].max(initial=0.0) for j, g in enumerate(self.groups)])

    def nearest(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance and row number of the nearest center of every row. An overflowing distance is infinite; NaN is
        above every number."""
        best, at = np.full(len(X), np.nan), np.zeros(len(X), np.int64)
        fits = np.all(np.abs(X) < SAFE, axis=1) if self.bounded else np.zeros(len(X), bool)
        odd = np.flatnonzero(~fits)
        for j in range(len(self.C) if len(odd) else 0):
            with np.errstate(over="ignore", invalid="ignore"):
                d = cross_distances(X[odd], self.C[j:j + 1])[:, 0]
            # strict, so the first keeps a tie
            closer = (d < best[odd]) | (np.isnan(best[odd]) & ~np.isnan(d))
            best[odd[closer]], at[odd[closer]] = d[closer], j
        self.distances += len(odd) * len(self.C)
        rows = np.flatnonzero(fits)
        if len(rows):
            best[rows], at[rows] = np.inf, len(self.C)
            to = cross_distances(X[rows], self.pivots)
            self.distances += to.size
            own = to.argmin(axis=1)
            for others in (False, True):
                for j, group in enumerate(self.groups):
                    near = (own != j) & (to[:, j] - self.radius[j] <= best[rows] * (1 + SLACK)) if others else own == j
                    self._measure(X, rows[near], group, best, at)
        return best, at

    def _measure(self, X, rows, group, best, at) -> None:
        if not len(rows):
            return
        D = cross_distances(X[rows], self.C[group])
        self.distances += D.size
        m = D.argmin(axis=1)                    # the first of equals: groups are in order
        d, c = D[np.arange(len(rows)), m], group[m]
        closer = (d < best[rows]) | ((d == best[rows]) & (c < at[rows]))
        best[rows[closer]], at[rows[closer]] = d[closer], c[closer]


def _nearest_udf(centers: CenterList):
    """Nearest center by Arrow batches, for large ``k * d``."""
    ids = np.array([j for j, _ in centers], dtype=np.int32)
    C = np.array([c for _, c in centers], dtype=np.float64)
    made: list[CenterIndex] = []

    @F.arrow_udf("struct<distance: double, center_id: int>")
    def nearest_center(coords: pa.Array) -> pa.Array:
        if not made:
            made.append(CenterIndex(C))     # once a task
        best, at = made[0].nearest(coords_matrix(coords, C.shape[1]))
        return pa.StructArray.from_arrays([pa.array(best, pa.float64()), pa.array(ids[at])], ["distance", "center_id"])

    return nearest_center


def nearest(x: Column | str, centers: CenterList) -> Column:
    """``struct(distance, center_id)`` of the nearest center (E2 body).

    Ties go to the lowest center id, whatever the order of ``centers``. A
    distance that overflows is infinite, one with a NaN coordinate NaN, and
    NaN is above infinity; both forms below agree on every row.
    """
    centers = sorted(centers, key=lambda t: t[0])
    x = F.col(x) if isinstance(x, str) else x
    d = len(centers[0][1])
    if len(centers) * d <= UNROLL_TERMS:
        cands = [F.struct(distance(x, c).alias("distance"), F.lit(j).cast("int").alias("center_id"))
                 for j, c in centers]
        return cands[0] if len(cands) == 1 else F.least(*cands)
    return _nearest_udf(centers)(x)


def assign_nearest(points: DataFrame, centers: DataFrame | Sequence,
                   keep: Sequence[str] = ()) -> DataFrame:
    """``(point_id, center_id, distance, *keep)`` for every point."""
    cl = centers if _is_center_list(centers) else centers_list(centers)
    m = nearest("coords", cl)
    return points.select("point_id", *keep, m.alias("_m")).select(
        "point_id", F.col("_m.center_id").alias("center_id"),
        F.col("_m.distance").alias("distance"), *keep)


def _is_center_list(c) -> bool:
    return (isinstance(c, list) and c and isinstance(c[0], tuple) and len(c[0]) == 2
            and isinstance(c[0][1], list))


def clustering_cost(points: DataFrame, centers: DataFrame | Sequence,
                    multiplicity: str | None = None) -> DataFrame:
    """One row ``cost`` = sum over points of the distance to the nearest center.

    Weights are ignored, as in the reference; ``multiplicity`` names a row
    count column when the points were merged (each row stands for that many
    input rows).
    """
    cl = centers if _is_center_list(centers) else centers_list(centers)
    dist = nearest("coords", cl)["distance"]
    term = dist * F.col(multiplicity) if multiplicity else dist
    return points.agg(F.sum(term).alias("cost"))


def clustering_cost_value(points: DataFrame, centers, multiplicity: str | None = None) -> float:
    row = clustering_cost(points, centers, multiplicity).first()
    return float(row["cost"]) if row and row["cost"] is not None else 0.0


def median_objective(points: DataFrame, centers: DataFrame | Sequence) -> DataFrame:
    """``(center_id, objective, n)``: sum of ``weight * distance`` per cluster."""
    cl = centers if _is_center_list(centers) else centers_list(centers)
    m = nearest("coords", cl)
    return (points.select(m.alias("_m"), "weight")
            .groupBy(F.col("_m.center_id").alias("center_id"))
            .agg(F.sum(F.col("weight") * F.col("_m.distance")).alias("objective"),
                 F.count("*").alias("n")))


def cluster_sizes(points: DataFrame, centers: DataFrame | Sequence) -> DataFrame:
    """``(center_id, n, weight)`` per non-empty cluster."""
    cl = centers if _is_center_list(centers) else centers_list(centers)
    m = nearest("coords", cl)
    return (points.select(m["center_id"].alias("center_id"), "weight")
            .groupBy("center_id")
            .agg(F.count("*").alias("n"), F.sum("weight").alias("weight")))
