"""Point sources and sinks.

A point table has the schema ``point_id BIGINT, coords ARRAY<DOUBLE>,
weight DOUBLE``. It is never collected: readers return lazy DataFrames and
only the dimension (from one row) and the number of splits reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINT_SCHEMA = "point_id BIGINT, coords ARRAY<DOUBLE>, weight DOUBLE"

# splits whose counts one window adds up, and offsets that are broadcast
SPLITS_AT_ONCE = 4096
BROADCAST_SPLITS = 1_000_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def _validate(coords: Column, d: int, invalid: str, where: Column) -> tuple[Column, Column]:
    """Return (coords or raise, keep-row predicate) for ``invalid``."""
    ok = (F.size(coords) == d) & F.forall(coords, _finite)
    ok = F.coalesce(ok, F.lit(False))
    if invalid == "fail":
        checked = F.when(ok, coords).otherwise(
            F.raise_error(F.concat(F.lit(f"invalid point (expected {d} finite "
                                         "coordinates) at "), where)))
        return checked, F.lit(True)
    if invalid == "drop":
        return coords, ok
    raise ValueError("invalid must be 'fail' or 'drop'")


def _has_exchange(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Exchange" in plan or "Sort " in plan


def running_offsets(counts: DataFrame) -> DataFrame:
    """``_split, _offset``: the rows before each split of ``counts(_split, count)``. Sums inside groups of splits,
    then over the groups, so that no task holds the counts of all splits."""
    grouped = counts.withColumn("_group", F.expr(f"_split div {SPLITS_AT_ONCE}"))
    inside = Window.partitionBy("_group").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(F.lit(0)).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("_group").agg(F.sum("count").alias("_n"))
    groups = groups.select("_group", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    rows = grouped.withColumn("_in", F.coalesce(F.sum("count").over(inside), F.lit(0)))
    return rows.join(groups, "_group").select("_split", (F.col("_before") + F.col("_in")).alias("_offset"))


def with_point_index(df: DataFrame, name: str = "point_id", reliable: bool = False) -> DataFrame:
    """Number the rows 0..n-1 in partition order (S3).

    The row numbers must be the same in the counting job and in every later
    read. A plan made only of file scans and narrow steps re-reads the same
    splits in the same order, so such an input is not materialized; an input
    with a shuffle or sort (whose layout a re-run could change), or
    ``reliable=True``, is checkpointed. One job counts the rows of each split
    (column-pruned); the counts stay a table, are added up in two levels, and the offsets (one per
    split) join back, by broadcast while they are at most ``BROADCAST_SPLITS``.
    """
    from tessera.session import checkpoint
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_split", F.shiftright("_mid", _ROW_BITS))
    if reliable or _has_exchange(df):
        tagged = checkpoint(tagged)
    offsets = checkpoint(running_offsets(checkpoint(tagged.groupBy("_split").count())))
    if offsets.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    return (tagged.join(offsets, "_split")
            .withColumn(name, F.col("_offset") + F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1))
            .drop("_mid", "_split", "_offset"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of a text file, directory or glob."""
    return spark.read.text(path)


def read_points_text(spark: SparkSession, path: str, d: int | None = None,
                     sep: str = "\t", min_partitions: int | None = None,
                     invalid: str = "fail") -> DataFrame:
    """Read delimited text, one point per line, every token a double.

    ``d`` defaults to the token count of the first line. Trailing separators
    are ignored. Ragged, unparsable or non-finite rows raise (``invalid=
    'fail'``) or are dropped (``'drop'``). Point ids are line numbers
    0..n-1 in split order.
    """
    lines = read_lines(spark, path)
    sep_re = "\\t" if sep == "\t" else _regex_escape(sep)
    body = F.regexp_replace(F.col("value"), f"({sep_re})+$", "")
    tokens = F.split(body, sep_re)
    if d is None:
        first = lines.select(F.size(tokens).alias("n")).first()
        if first is None:
            raise ValueError(f"no lines in {path}")
        d = int(first["n"])
    parsed = lines.select(F.col("value"),
                          F.transform(tokens, lambda t: F.trim(t).try_cast("double")).alias("coords"))
    indexed = with_point_index(parsed)
    coords, keep = _validate(F.col("coords"), d, invalid,
                             F.concat(F.lit("line "), F.col("point_id").cast("string")))
    out = indexed.where(keep).select("point_id", coords.alias("coords", metadata={"dim": d}),
                                     F.lit(1.0).alias("weight"))
    if min_partitions and out.rdd.getNumPartitions() < min_partitions:
        out = out.repartition(min_partitions)
    return out


def _regex_escape(s: str) -> str:
    import re
    return re.escape(s)


def read_points_table(source: DataFrame | str, columns: Sequence[str] | str,
                      id_col: str | None = None, weight_col: str | None = None,
                      spark: SparkSession | None = None,
                      invalid: str = "fail") -> DataFrame:
    """Point rows from table columns.

    ``columns`` is a list of numeric columns (one coordinate each) or the
    name of one array column. ``source`` is a DataFrame or a parquet path.
    Only the named columns are read (the scan's ReadSchema is pruned).
    Without ``id_col`` the rows are numbered (S3).
    """
    if isinstance(source, str):
        if spark is None:
            spark = SparkSession.getActiveSession()
        source = spark.read.parquet(source)
    if isinstance(columns, str):
        coords = F.transform(F.col(columns), lambda v: v.cast("double"))
        d = None
    else:
        coords = F.array(*[F.col(c).cast("double") for c in columns])
        d = len(columns)
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    keep_cols = ([id_col] if id_col else []) + ([columns] if isinstance(columns, str) else list(columns))
    if weight_col:
        keep_cols.append(weight_col)
    base = source.select(*keep_cols)
    if id_col:
        pts = base.select(F.col(id_col).cast("bigint").alias("point_id"),
                          coords.alias("coords"), weight.alias("weight"))
    else:
        pts = with_point_index(base.select(coords.alias("coords"), weight.alias("weight")))
        pts = pts.select("point_id", "coords", "weight")
    if d is None:
        first = pts.select(F.size("coords").alias("n")).first()
        d = int(first["n"]) if first else 0
    # the message names the coordinates, not the id, so scans that do not
    # need the id column do not read it
    checked, keep = _validate(F.col("coords"), d, invalid, F.to_json(F.col("coords")))
    return pts.where(keep).select("point_id", checked.alias("coords", metadata={"dim": d}), "weight")


def point_dimension(points: DataFrame) -> int:
    """Dimension of a point table: from the ``coords`` column's metadata
    (set by the readers), else from one row."""
    meta = points.schema["coords"].metadata or {}
    if "dim" in meta:
        return int(meta["dim"])
    row = points.select(F.size("coords").alias("d")).first()
    if row is None:
        raise ValueError("empty point table")
    return int(row["d"])


def write_points_text(points: DataFrame, path: str, sep: str = "\t") -> None:
    """Write points as delimited text, one line per point, in parallel."""
    (points.select(F.array_join(F.transform("coords", lambda v: v.cast("string")), sep)
                   .alias("value"))
     .write.mode("overwrite").text(path))


def write_result(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a result table (centers, assignments, metrics) as parquet."""
    df.write.mode(mode).parquet(path)


def explode_coords(df: DataFrame, d: int, col: str = "coords", prefix: str = "x") -> DataFrame:
    """Replace an array column by scalar columns ``x0..x{d-1}``."""
    others = [c for c in df.columns if c != col]
    return df.select(*others, *[F.col(col).getItem(i).alias(f"{prefix}{i}") for i in range(d)])
