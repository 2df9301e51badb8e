"""Vector column functions over ``coords ARRAY<DOUBLE>``.

Every function returns a Column, so it stays inside whole-stage codegen.
Two forms exist for the distance-like functions:

* unrolled: ``sqrt((x[0]-c0)^2 + ... )`` when the dimension is known and
  small; a flat arithmetic expression the code generator compiles whole;
* higher-order: ``aggregate(zip_with(x, c, ...))`` for large dimensions,
  where an unrolled tree would grow the generated method past the JIT limit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# above this many terms the unrolled form is replaced by zip_with/aggregate
UNROLL_LIMIT = 32


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coord(x: Column | str, i: int) -> Column:
    """Coordinate ``i`` of a point."""
    return _col(x).getItem(i)


def dimension(x: Column | str) -> Column:
    """Number of coordinates."""
    return F.size(_col(x))


def as_vector(values: Sequence[float]) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def squared_distance(x: Column | str, c: Sequence[float] | Column | str,
                     d: int | None = None) -> Column:
    """Squared Euclidean distance between a point and a point (V1 body).

    ``c`` may be a literal vector (list of floats) or an array column.
    With ``d`` known and small, the sum is unrolled.
    """
    x = _col(x)
    literal = not isinstance(c, (Column, str))
    if literal:
        d = len(c)
    if d is not None and d <= UNROLL_LIMIT:
        terms = []
        for i in range(d):
            ci = F.lit(float(c[i])) if literal else _col(c).getItem(i)
            diff = x.getItem(i) - ci
            terms.append(diff * diff)
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total
    cvec = as_vector(c) if literal else _col(c)
    return F.aggregate(F.zip_with(x, cvec, lambda a, b: (a - b) * (a - b)),
                       F.lit(0.0), lambda s, v: s + v)


def distance(x: Column | str, c: Sequence[float] | Column | str,
             d: int | None = None) -> Column:
    """Euclidean distance (V1)."""
    return F.sqrt(squared_distance(x, c, d))


def squared_norm(x: Column | str, d: int | None = None) -> Column:
    """Squared norm (V2)."""
    x = _col(x)
    if d is not None and d <= UNROLL_LIMIT:
        total = x.getItem(0) * x.getItem(0)
        for i in range(1, d):
            total = total + x.getItem(i) * x.getItem(i)
        return total
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)


def norm(x: Column | str, d: int | None = None) -> Column:
    """Euclidean norm (V2)."""
    return F.sqrt(squared_norm(x, d))


def add(x: Column | str, y: Column | str) -> Column:
    """Coordinate-wise sum (V3, per row)."""
    return F.zip_with(_col(x), _col(y), lambda a, b: a + b)


def subtract(x: Column | str, y: Column | str | Sequence[float]) -> Column:
    """Coordinate-wise difference ``x - y`` (V4)."""
    yy = as_vector(y) if not isinstance(y, (Column, str)) else _col(y)
    return F.zip_with(_col(x), yy, lambda a, b: a - b)


def scale(x: Column | str, k: Column | float) -> Column:
    """Multiply every coordinate by ``k`` (V5)."""
    kk = k if isinstance(k, Column) else F.lit(float(k))
    return F.transform(_col(x), lambda v: v * kk)


def equal(x: Column | str, y: Column | str | Sequence[float]) -> Column:
    """All coordinates equal (V6). ``0.0`` equals ``-0.0``."""
    yy = as_vector(y) if not isinstance(y, (Column, str)) else _col(y)
    return _col(x) == yy


def to_text(x: Column | str) -> Column:
    """Print as ``a,b,c`` using the shortest round-trip double text (V8)."""
    return F.array_join(F.transform(_col(x), lambda v: v.cast("string")), ",")


def sum_vectors(x: Column | str, d: int, prefix: str = "s") -> list[Column]:
    """Per-dimension sums inside a ``groupBy().agg`` (V3 as an accumulator).

    Returns ``d`` aggregate columns named ``{prefix}{i}``: fixed-size partial
    sums combine map-side, unlike concatenated member lists.
    """
    return [F.sum(_col(x).getItem(i)).alias(f"{prefix}{i}") for i in range(d)]


def lexicographic_index(points, col: str = "coords", name: str = "ord"):
    """Position ``0..n-1`` of every row in lexicographic coordinate order,
    ties by ``point_id`` (V7).

    A distributed range sort, then the per-partition offsets of
    ``with_point_index``; no single-partition window.
    """
    from tessera.sources.points import with_point_index
    return with_point_index(points.orderBy(col, "point_id"), name, reliable=True)


# ----------------------------------------------------------------- numpy, inside tasks


def cross_distances(P: np.ndarray, C: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of ``P`` and of ``C``.

    Squares are summed dimension by dimension in order, the same sum as the
    SQL and Spark expressions, in one buffer updated in place.
    """
    D = np.subtract.outer(P[:, 0], C[:, 0])
    np.multiply(D, D, out=D)
    for i in range(1, P.shape[1]):
        T = np.subtract.outer(P[:, i], C[:, i])
        np.multiply(T, T, out=T)
        D += T
    return np.sqrt(D, out=D)


def coords_matrix(column, d: int) -> np.ndarray:
    """An Arrow column of coordinate arrays as an ``m x d`` matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)
