"""Sources: text parsing rules (S1), ids (S3), table columns."""

import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from tessera.sources import points as SP


def _write(lines):
    d = tempfile.mkdtemp(prefix="tessera-text-")
    with open(os.path.join(d, "part-0.txt"), "w") as f:
        f.write("\n".join(lines) + "\n")
    return d


LINES = ["1\t2", "3\t4\t", "5", "", "NaN\t1", "1e3\t7", "word\t2"]


def test_text_drop_keeps_valid_rows(spark):
    pts = SP.read_points_text(spark, _write(LINES), invalid="drop")
    rows = sorted((r["point_id"], list(r["coords"])) for r in pts.collect())
    assert rows == [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (5, [1000.0, 7.0])]


def test_text_fail_raises(spark):
    pts = SP.read_points_text(spark, _write(LINES))
    with pytest.raises(Exception):
        pts.collect()


def test_text_dimension_from_first_line(spark):
    pts = SP.read_points_text(spark, _write(["1\t2\t3", "4\t5\t6"]))
    assert SP.point_dimension(pts) == 3


def test_point_index_is_contiguous(spark):
    src = spark.read.parquet(f"{SF01}/lineitem.parquet").repartition(7)
    pts = SP.read_points_table(src, ["l_quantity", "l_discount", "l_tax"])
    agg = pts.agg(F.min("point_id"), F.max("point_id"), F.countDistinct("point_id"), F.count("*")).first()
    assert tuple(agg) == (0, 59999, 60000, 60000)


def test_array_column_source(spark):
    pts = SP.read_points_table(f"{SF01}/embeddings.parquet", "embedding", id_col="vec_id", spark=spark)
    assert SP.point_dimension(pts) == 64
    assert pts.count() == 500


def test_table_source_prunes_columns(spark):
    src = spark.read.parquet(f"{SF01}/part.parquet")
    pts = SP.read_points_table(src, ["p_size", "p_retailprice"], id_col="p_partkey")
    plan = pts._jdf.queryExecution().executedPlan().toString()
    assert "p_name" not in plan and "p_brand" not in plan


def test_text_roundtrip_is_exact(spark):
    src = spark.read.parquet(f"{SF01}/part.parquet")
    pts = SP.read_points_table(src, ["p_size", "p_retailprice"], id_col="p_partkey")
    d = tempfile.mkdtemp(prefix="tessera-rt-")
    SP.write_points_text(pts, d + "/t")
    back = SP.read_points_text(spark, d + "/t")
    a = sorted(tuple(r["coords"]) for r in pts.collect())
    b = sorted(tuple(r["coords"]) for r in back.collect())
    assert a == b


def test_offsets_of_many_splits(spark):
    """100,000 splits, some missing, with counts up to millions: the running sum of a plain loop."""
    rng = np.random.default_rng(2)
    splits = np.sort(rng.choice(130_000, 100_000, replace=False))
    counts = rng.integers(1, 5_000_000, len(splits))
    table = spark.createDataFrame(pd.DataFrame({"_split": splits, "count": counts})).repartition(7)
    got = {r["_split"]: r["_offset"] for r in SP.running_offsets(table).collect()}
    assert got == dict(zip(splits.tolist(), (np.cumsum(counts) - counts).tolist()))


def test_ids_of_a_file_are_line_numbers(spark, monkeypatch):
    lines = [f"{i}\t{i % 7}" for i in range(5000)]
    path = _write(lines)
    for limit in (SP.BROADCAST_SPLITS, 0):
        monkeypatch.setattr(SP, "BROADCAST_SPLITS", limit)
        rows = SP.read_points_text(spark, path).collect()
        assert len(rows) == 5000 and all(r["point_id"] == r["coords"][0] for r in rows)
