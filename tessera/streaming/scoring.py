"""Nearest-center scoring of a point stream.

The reference has no streaming. Its assignment (E2) is a narrow projection
with the centers as literals, so it runs unchanged on a streaming DataFrame:
no state, no shuffle. The running per-center totals (E1/W1 on a stream) are
a streaming aggregation whose state holds one row per center (``k`` keys),
so it stays bounded however long the stream runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.assign import CenterList, nearest


def score_stream(points: DataFrame, centers: CenterList) -> DataFrame:
    """``point_id, center_id, distance`` for every arriving point."""
    m = nearest("coords", centers)
    return points.select("point_id", m["center_id"].alias("center_id"),
                         m["distance"].alias("distance"))


def running_cluster_totals(points: DataFrame, centers: CenterList) -> DataFrame:
    """Per center: points seen, summed distance and weight so far.

    Use with output mode ``complete`` or ``update``; the state is ``k`` rows.
    """
    m = nearest("coords", centers)
    return (points.select(m["center_id"].alias("center_id"), m["distance"].alias("distance"), "weight")
            .groupBy("center_id")
            .agg(F.count("*").alias("n"), F.sum("distance").alias("cost"),
                 F.sum("weight").alias("weight")))


def points_stream(spark, path: str, columns: list[str], id_col: str,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """A point stream from parquet files arriving in ``path`` (schema taken
    from the files already there)."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(path)
    return src.select(F.col(id_col).cast("bigint").alias("point_id"),
                      F.array(*[F.col(c).cast("double") for c in columns]).alias("coords"),
                      F.lit(1.0).alias("weight"))
