"""Reading tables, written intermediate tables and connected components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.session import checkpoint, scratch_path, written_at


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, so a
    lost executor re-reads files instead of replaying the plan."""
    return written_at(df, scratch_path(df.sparkSession, name))


#: so many counted rows, or array values in them, are broadcast
BROADCAST_ROWS = 1_000_000


def counted(df: DataFrame, values: str | None = None) -> DataFrame:
    """``df``, checkpointed and counted, with a broadcast hint if its rows (with ``values``, the
    values of that array column) are at most BROADCAST_ROWS; else a join shuffles it."""
    df = checkpoint(df)
    n = df.agg(F.sum(F.size(values) + 1) if values else F.count("*")).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def arrow_type_of(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and
    small-star steps (Kiveris et al.), on edge rows only.

    ``edges(a, b)`` -> ``(node, root)`` for every node with an edge to another
    node; ``root`` is the smallest node of the component. Each step is a minimum
    per node and a join back, so a node with any number of neighbours is
    pre-aggregated and its join can be split.
    """
    e = (edges.where("a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = checkpoint(e)
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        up = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(up.union(low.select("u", F.col("m").alias("v"))).distinct())
    node = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return node.union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
