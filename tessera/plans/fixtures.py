"""Point sets drawn from the test tables, shared by the registered queries.

Each point set has a Spark builder and the matching DuckDB SQL that yields
the same rows (``point_id, x0..x{d-1}``), so every registered query and its
oracle start from the same points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.points import read_points_table


@dataclass(frozen=True)
class PointSet:
    table: str
    columns: tuple[str, ...] | str   # scalar columns, or one array column
    id_col: str
    d: int

    def load(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        src = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        cols = self.columns if isinstance(self.columns, str) else list(self.columns)
        return read_points_table(src, cols, id_col=self.id_col)

    def sql(self) -> str:
        """DuckDB rows ``point_id, x0..x{d-1}, weight``."""
        if isinstance(self.columns, str):
            xs = ", ".join(f"CAST({self.columns}[{i + 1}] AS DOUBLE) AS x{i}" for i in range(self.d))
        else:
            xs = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(self.columns))
        return (f"SELECT CAST({self.id_col} AS BIGINT) AS point_id, {xs}, CAST(1.0 AS DOUBLE) AS weight "
                f"FROM {self.table}")


# P1 of FIXTURES.md: comparable scales, unique key
PART = PointSet("part", ("p_size", "p_retailprice"), "p_partkey", 2)
# Skewed density
EVENTS = PointSet("events", ("value", "user_id"), "event_id", 2)
# P5: 64-dimensional unit vectors
EMBED = PointSet("embeddings", "embedding", "vec_id", 64)
# One dimension, negative values
CUSTOMER = PointSet("customer", ("c_acctbal",), "c_custkey", 1)


def first_k_centers(points: DataFrame, k: int) -> list[tuple[int, list[float]]]:
    """Centers = the ``k`` points with the lowest ids (a top-k, k rows)."""
    rows = points.orderBy("point_id").limit(k).select("coords").collect()
    return [(j, [float(v) for v in r["coords"]]) for j, r in enumerate(rows)]


def centers_sql(ps: PointSet, k: int) -> str:
    """DuckDB rows ``center_id, c0..c{d-1}`` for :func:`first_k_centers`."""
    cs = ", ".join(f"x{i} AS c{i}" for i in range(ps.d))
    return (f"SELECT CAST(row_number() OVER (ORDER BY point_id) - 1 AS INTEGER) AS center_id, {cs} "
            f"FROM ({ps.sql()}) ORDER BY point_id LIMIT {k}")


def rnd(c, n: int):
    """Round and fold ``-0.0`` into ``0.0`` so both engines print alike."""
    return F.round(c, n) + F.lit(0.0)


def sql_dist(d: int, a: str = "x", b: str = "c", pa: str = "", pb: str = "") -> str:
    """DuckDB Euclidean distance between ``{pa}{a}i`` and ``{pb}{b}i``."""
    terms = " + ".join(f"({pa}{a}{i} - {pb}{b}{i}) * ({pa}{a}{i} - {pb}{b}{i})" for i in range(d))
    return f"sqrt({terms})"
