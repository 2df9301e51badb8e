"""Nearest-center scoring on a stream equals the batch result."""

import tempfile


from conftest import SF01
from tessera.operators import assign as A
from tessera.plans.fixtures import PART, first_k_centers
from tessera.streaming.scoring import points_stream, running_cluster_totals, score_stream


def test_stream_scoring_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="tessera-stream-")
    spark.read.parquet(f"{SF01}/part.parquet").repartition(4).write.parquet(d + "/in")
    batch = PART.load(spark, SF01)
    ctr = first_k_centers(batch, 5)
    stream = points_stream(spark, d + "/in", ["p_size", "p_retailprice"], "p_partkey",
                           max_files_per_trigger=1)
    q1 = (score_stream(stream, ctr).writeStream.format("memory").queryName("scored")
          .option("checkpointLocation", d + "/ck1").outputMode("append").start())
    q2 = (running_cluster_totals(stream, ctr).writeStream.format("memory").queryName("totals")
          .option("checkpointLocation", d + "/ck2").outputMode("complete").start())
    q1.processAllAvailable()
    q2.processAllAvailable()
    q1.stop()
    q2.stop()
    got = {r["point_id"]: (r["center_id"], r["distance"]) for r in spark.sql("SELECT * FROM scored").collect()}
    want = {r["point_id"]: (r["center_id"], r["distance"]) for r in A.assign_nearest(batch, ctr).collect()}
    assert got == want
    tot = {r["center_id"]: r["n"] for r in spark.sql("SELECT * FROM totals").collect()}
    sizes = {r["center_id"]: r["n"] for r in A.cluster_sizes(batch, ctr).collect()}
    assert tot == sizes


def test_stream_scoring_with_many_centers_matches_batch(spark):
    """k * d above the unroll limit: the Arrow-batched path on a stream."""
    d = tempfile.mkdtemp(prefix="tessera-stream-hd-")
    spark.read.parquet(f"{SF01}/part.parquet").repartition(3).write.parquet(d + "/in")
    batch = PART.load(spark, SF01)
    ctr = first_k_centers(batch, 40)
    stream = points_stream(spark, d + "/in", ["p_size", "p_retailprice"], "p_partkey")
    q = (score_stream(stream, ctr).writeStream.format("memory").queryName("scored_hd")
         .option("checkpointLocation", d + "/ck").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = {r["point_id"]: (r["center_id"], r["distance"]) for r in spark.sql("SELECT * FROM scored_hd").collect()}
    want = {r["point_id"]: (r["center_id"], r["distance"]) for r in A.assign_nearest(batch, ctr).collect()}
    assert got == want
