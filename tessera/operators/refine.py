"""Refinement: replace every center by the geometric median of its cluster
(W1-W9), with Weiszfeld's iteration and the Vardi-Zhang step off a data point.

Plan: one ``groupBy(center_id)`` aggregate per pass serves all clusters
still moving. Per cluster it sums, over points ``a`` not equal to the
current estimate ``x``:

    R_i = sum(w * (a_i - x_i) / |x - a|),  den = sum(w / |x - a|)

and ``w_at`` = total weight of points equal to ``x``. Centered sums keep
their precision on huge clusters near the optimum, where ``num - x * den``
would cancel. Then on the driver (k rows): if ``w_at == 0``,
``x' = x + R / den`` (operator T, the weighted mean of the points with
weights ``w / |x - a|``); otherwise stay when ``|R| <= w_at``, else step
``x' = x + (|R| - w_at) / den * R / |R|`` (operator S; the direction is
``+R``, which decreases the objective, D2). Stop a cluster when the step is
at most ``epsilon`` or ``max_passes`` is reached.

Weiszfeld's steps shrink by a constant factor, close to 1 where a cluster is much longer than
wide: dozens of scans. ``method="newton"`` sums the curvature in the same aggregate,

    M_ij = sum(w * (a_i - x_i) * (a_j - x_j) / |x - a|^3),   H = den * I - M

and steps by ``H^-1 R``, a handful of scans. Safeguards: the objective comes with the sums, and a step
that raised it is taken back, for shorter ones and then the Weiszfeld step from the place before, which
never raises it; and where the pull of all other points is no more than the nearest point's weight, so that the
median may be that point (where H is useless), the point itself is tried. Beyond
``NEWTON_DIMS`` dimensions M has no direction of much weight and plain steps shrink by about 1 / d;
they are taken there.

A refinement assigns the points to its start centers once and keeps the assigned rows (cached, with
the input, a checkpoint in a run, as lineage), coordinates as plain columns while there are few; a
merged point table (distinct coordinates with weights, W2) keeps the passes
small when the data repeat. The current estimates enter a pass as literals, or as a k-row
broadcast table keyed by center id when k * d is large, so the plan has one size whatever k and
the ids are, and settled clusters are filtered out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import squared_distance
from tessera.operators.assign import UNROLL_TERMS, CenterList, nearest
from tessera.session import persist

# fixed value: the median loop stops when a step is at most 0.01, with no
# cap on the number of passes
EPSILON = 0.01

# curvature is summed, and coordinates are kept as columns, up to so many dimensions
NEWTON_DIMS = 8
# passes after which the nearest point is tried whatever its weight
TRY_POINT = 5
# relative rise of the objective that is summation order
SAME = 1e-13
# times that a second-order step which raised the objective is shortened before the Weiszfeld step
SHORTER = 3


def merge_duplicates(points: DataFrame) -> DataFrame:
    """Distinct coordinates with ``n`` (row count) and summed ``weight``.
    Partial aggregation combines copies before the shuffle."""
    return points.groupBy("coords").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"),
                                        F.min("point_id").alias("point_id"))


def estimates(spark, xs: dict[int, list[float]]) -> DataFrame:
    """The current estimates as rows ``center_id, _x``."""
    return spark.createDataFrame([(int(j), [float(v) for v in x]) for j, x in xs.items()],
                                 "center_id INT, _x ARRAY<DOUBLE>")


def flat_columns(d: int) -> list[str]:
    return [f"x_{i}" for i in range(d)]


def _literal(v: float) -> str:
    return f"{v!r}D" if math.isfinite(v) else f"double('{v}')"


def _pass_rows(assigned: DataFrame, xs: dict[int, list[float]], d: int) -> DataFrame:
    """The rows of the clusters in ``xs`` with ``_d0..`` (differences to the estimate), ``_at`` (equal to it) and
    ``_dist``. Built from SQL text: a pass is short, and so is the text against a tree of calls."""
    flat = "x_0" in assigned.columns
    mult = "n" if "n" in assigned.columns else "1"
    coord = [f"x_{i}" if flat else f"coords[{i}]" for i in range(d)]
    if len(xs) * d <= UNROLL_TERMS:
        rows = assigned.where(f"center_id IN ({', '.join(map(str, xs))})")
        # literals instead of a table of estimates: no job for the broadcast
        at = ["CASE center_id " + " ".join(f"WHEN {j} THEN {_literal(x[i])}" for j, x in xs.items()) + " END" for i in range(d)]
        equal = " AND ".join(f"{coord[i]} = _x{i}" for i in range(d))
        rows = rows.selectExpr("*", *[f"{x} AS _x{i}" for i, x in enumerate(at)])
    else:
        rows = assigned.join(F.broadcast(estimates(assigned.sparkSession, xs)), "center_id")
        rows = rows.selectExpr("*", *[f"_x[{i}] AS _x{i}" for i in range(d)]) if flat else rows
        equal = " AND ".join(f"{coord[i]} = _x{i}" for i in range(d)) if flat else "coords = _x"
    if not flat and "_x" in rows.columns:
        return rows.select("center_id", "weight", F.expr(mult).alias("_mult"), F.expr(equal).alias("_at"),
                           *[(F.col("coords")[i] - F.col("_x")[i]).alias(f"_d{i}") for i in range(d)],
                           F.sqrt(squared_distance("coords", "_x", d)).alias("_dist"))
    rows = rows.selectExpr("center_id", "weight", f"{mult} AS _mult", f"({equal}) AS _at", *[f"{c} - _x{i} AS _d{i}" for i, c in enumerate(coord)])
    return rows.selectExpr("*", f"sqrt({' + '.join(f'_d{i} * _d{i}' for i in range(d))}) AS _dist")


def pass_stats(assigned: DataFrame, xs: dict[int, list[float]], d: int, curvature: bool = False) -> DataFrame:
    """One Weiszfeld pass aggregate: ``center_id, r_0.., den, w_at, n``
    for the clusters in ``xs`` (W3-W5). ``assigned`` has ``coords``, or ``x_0..`` in its place.

    With ``curvature`` also ``m_0_0..`` (the upper triangle of M), ``obj`` (the weighted
    objective) and the nearest other point ``near_0.., near_w, near_dist``."""
    away = "CASE WHEN NOT _at AND _dist > 0 THEN {} END"
    aggs = {f"r_{i}": f"sum({away.format(f'weight * _d{i} / _dist')})" for i in range(d)}
    # input rows times distance to x: at the first pass x is the
    # cluster's center, so this sums to the clustering cost
    aggs |= {"den": f"sum({away.format('weight / _dist')})", "w_at": "sum(CASE WHEN _at THEN weight END)", "n": "count(*)",
             "cost": "sum(_mult * _dist)"}
    if curvature:
        gap = away.format("_dist")
        aggs |= {f"m_{i}_{j}": f"sum({away.format(f'weight / (_dist * _dist * _dist) * _d{i} * _d{j}')})" for i in range(d) for j in range(i, d)}
        aggs |= {"obj": "sum(weight * _dist)", "near_dist": f"min({gap})", "near_w": f"min_by(weight, {gap})"}
        aggs |= {f"near_{i}": f"min_by(_d{i}, {gap})" for i in range(d)}
    return _pass_rows(assigned, xs, d).groupBy("center_id").agg(*[F.expr(e).alias(name) for name, e in aggs.items()])


def weiszfeld_update(x: list[float], R: list[float], den: float, w_at: float):
    """New estimate from one pass's sums; returns (x', branch)."""
    if not w_at:
        if not den:
            return list(x), "stay"
        return [x[i] + R[i] / den for i in range(len(x))], "T"
    rn = math.sqrt(sum(r * r for r in R))
    if rn <= w_at or not den:
        return list(x), "stay"
    t = (rn - w_at) / den
    return [x[i] + t * R[i] / rn for i in range(len(x))], "S"


def newton_update(x: list[float], row, d: int) -> list[float] | None:
    """The second-order step from a pass's sums, or None where the curvature gives no descent."""
    R = np.array([float(row[f"r_{i}"] or 0.0) for i in range(d)])
    H = np.eye(d) * float(row["den"] or 0.0)
    for i in range(d):
        for j in range(i, d):
            m = float(row[f"m_{i}_{j}"] or 0.0)
            H[i, j] -= m
            if i != j:
                H[j, i] -= m
    try:
        p = np.linalg.solve(H, R)
    except np.linalg.LinAlgError:
        return None
    if not np.all(np.isfinite(p)) or p @ R <= 0:
        return None
    return [float(v) for v in np.asarray(x) + p]


def near_point(x: list[float], row, d: int) -> tuple[list[float], bool] | None:
    """The nearest point, and whether the pull of all others there, as seen from ``x``, is no more than its weight."""
    if row["near_dist"] is None:
        return None
    off, r, w = [float(row[f"near_{i}"]) for i in range(d)], float(row["near_dist"]), float(row["near_w"])
    rest = [float(row[f"r_{i}"] or 0.0) - w * off[i] / r for i in range(d)]
    return [a + b for a, b in zip(x, off)], math.sqrt(sum(v * v for v in rest)) <= w


@dataclass
class MedianResult:
    centers: dict[int, list[float]]
    passes: dict[int, int] = field(default_factory=dict)
    jobs: int = 0
    start_cost: float = 0.0     # clustering cost of the start centers (E1)


@dataclass
class _Place:
    """Where a cluster was before its last step, its objective there, the Weiszfeld step from there, and the
    bold step that was tried: ``x + part * p``, down which the objective falls by ``slope`` at first; and the
    nearest point there."""
    x: list[float]
    objective: float
    safe: list[float]
    p: list[float]
    slope: float
    point: list[float] | None
    part: float = 1.0
    tries: int = 0

    def at(self) -> list[float]:
        return [a + self.part * b for a, b in zip(self.x, self.p)]

    def shorten(self, objective: float) -> bool:
        """After a step that raised the objective: the part at which a parabola through what is known is lowest;
        False when steps have been shortened enough."""
        self.tries += 1
        if self.tries > SHORTER or self.slope <= 0 or not math.isfinite(objective):
            return False
        rise = objective - self.objective + self.slope * self.part
        self.part *= min(0.5, max(0.02, self.slope * self.part / (2 * rise)))
        return True


def _gap(a: list[float], b: list[float]) -> float:
    return math.sqrt(sum((u - v) ** 2 for u, v in zip(a, b)))


def geometric_medians(assigned: DataFrame, start: dict[int, list[float]], d: int,
                      epsilon: float = EPSILON, max_passes: int | None = None, method: str = "weiszfeld") -> MedianResult:
    """Weiszfeld/Vardi-Zhang iteration for every cluster at once.

    ``assigned`` has ``center_id, coords, weight`` (or ``x_0..`` for ``coords``). One job a pass over the
    rows of the clusters still moving. Clusters with no points keep their
    start (D8). ``method`` is ``weiszfeld`` for its plain steps, or ``newton``.
    """
    if method not in ("weiszfeld", "newton"):
        raise ValueError("method must be 'weiszfeld' or 'newton'")
    newton = method == "newton" and d <= NEWTON_DIMS
    xs = {j: list(map(float, v)) for j, v in start.items()}
    active = dict(xs)
    passes = {j: 0 for j in xs}
    before: dict[int, _Place] = {}      # only after a step that may have raised the objective
    tried: dict[int, set] = {j: set() for j in xs}
    jobs = 0
    start_cost = 0.0
    while active:
        rows = pass_stats(assigned, active, d, newton).collect()      # at most k rows
        moving = {}
        for r in rows:
            j = int(r["center_id"])
            if not jobs:
                start_cost += float(r["cost"] or 0.0)
            x = active[j]
            passes[j] += 1
            last = before.pop(j, None)
            go = False
            if last and not float(r["obj"]) <= last.objective * (1 + SAME):
                new, at = last.safe, last.x
                if last.shorten(float(r["obj"])):
                    new, before[j] = last.at(), last
                elif _gap(new, at) <= epsilon and last.point and tuple(last.point) not in tried[j]:
                    # so near a point Weiszfeld steps are short wherever the median is; from the point they are not
                    tried[j].add(tuple(last.point))
                    new, go = last.point, True
            else:
                R = [float(r[f"r_{i}"] or 0.0) for i in range(d)]
                (new, branch), at = weiszfeld_update(x, R, float(r["den"] or 0.0), float(r["w_at"] or 0.0)), x
                if newton and branch == "T":
                    bold = newton_update(x, r, d)
                    point = near_point(x, r, d)
                    if point and (point[1] or passes[j] % TRY_POINT == 0) and tuple(point[0]) not in tried[j] and _gap(bold or new, x) > epsilon:
                        tried[j].add(tuple(point[0]))
                        bold = point[0]
                    if bold is not None:
                        p = [b - a for a, b in zip(x, bold)]
                        before[j] = _Place(x, float(r["obj"]), new, p, sum(a * b for a, b in zip(R, p)), point and point[0])
                        new = bold
            xs[j] = new
            if (go or _gap(new, at) > epsilon) and (max_passes is None or passes[j] < max_passes):
                moving[j] = new
        active = moving
        jobs += 1
    return MedianResult(xs, passes, jobs, start_cost)


def assign_to(points: DataFrame, centers: CenterList) -> DataFrame:
    """``center_id, coords, weight, n`` (plus ``point_id``) of each point's
    nearest center (E2 projection used by W1/W8)."""
    m = nearest("coords", centers)
    cols = [c for c in ("point_id", "n") if c in points.columns]
    return points.select(*cols, "coords", "weight", m["center_id"].alias("center_id"))


def refine_once(points: DataFrame, centers: CenterList, d: int, epsilon: float = EPSILON,
                max_passes: int | None = None, method: str = "newton") -> tuple[CenterList, MedianResult]:
    """Assign, then move every center to its cluster's geometric median.

    The assigned rows are cached for the passes; a lost block is assigned again from ``points``."""
    assigned = assign_to(points, centers)
    if d <= NEWTON_DIMS:
        n = ["n"] if "n" in assigned.columns else []
        assigned = assigned.select("center_id", *n, *[F.col("coords")[i].alias(x) for i, x in enumerate(flat_columns(d))], "weight")
    assigned = persist(assigned)
    try:
        res = geometric_medians(assigned, {j: c for j, c in centers}, d, epsilon, max_passes, method)
    finally:
        assigned.unpersist()
    return [(j, res.centers[j]) for j, _ in centers], res
