"""Benchmark the headline operators at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "total_wall", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Headline set (SURVEY §6): adaptive grid (G7), per-cell k-medoids (A3),
sample search (A11), clustering cost (E1), one refinement (W8) and the whole
run (M1) on part and lineitem(l_quantity, l_extendedprice), plus nearest
center on the 64-d embeddings (no gridding). Scoring rounds are timed with the building of their
blocks; medians and refinements by plain Weiszfeld passes and by second-order ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tessera.operators import assign as A  # noqa: E402
from tessera.operators import grid as G  # noqa: E402
from tessera.operators import refine as W  # noqa: E402
from tessera.operators import sample as SM  # noqa: E402
from tessera.operators import search as SR  # noqa: E402
from tessera.plans import run as PL  # noqa: E402
from tessera.plans.fixtures import EMBED, PART, PointSet, first_k_centers  # noqa: E402
from tessera.session import local_session, persist  # noqa: E402

LINEITEM = PointSet("lineitem", ("l_quantity", "l_extendedprice"), "", 2)


def load_lineitem(spark, sf_dir):
    from tessera.sources.points import read_points_table
    src = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return read_points_table(src, ["l_quantity", "l_extendedprice"])


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus), app="tessera-bench")
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    # warm the JVM and the Python workers outside the clock
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(0, 10000, 1, int(cpus)).mapInPandas(lambda it: it, "id BIGINT").count()

    part = persist(PART.load(spark, sf_dir))
    part.count()
    line = load_lineitem(spark, sf_dir)   # numbered at each read
    line.count()

    # G7 adaptive grid
    timed("grid_part", lambda: G.adaptive_grid(part, 200, 2).points.count())
    timed("grid_lineitem", lambda: G.adaptive_grid(line, 600, 2).points.count())

    # A3 per-cell k-medoids sample, A11 search over it
    def sample_part():
        grid = G.adaptive_grid(part, 20, 2)
        merged = SM.merged_cells(grid)
        return persist(SM.cell_pam(merged, 2, grid.avg_per_cell)), grid
    sample, _ = timed("sample_part", lambda: (lambda s: (s[0], s[0].count()))(sample_part()))
    timed("search_part", lambda: SR.sample_medoids(sample, 5, 2))

    # one scoring round over the sample, all slots (BASELINE: swap pass), with building the blocks
    def swap_pass(points, k):
        med = SR.initial_global(points, k)
        return SR.best_swaps(SR.block_pairs(points, 2), SR.medoid_coords(points, med), med, list(range(k)))
    timed("swap_pass_part", lambda: swap_pass(sample, 5))

    # the same with 40,000 and 200,000 points against as many candidates
    def first_lines(n):
        return persist(line.limit(n).withColumn("rank", SM.seeded_rank("point_id", 0)))
    timed("swap_pass_40k", lambda: swap_pass(first_lines(40_000), 5))
    timed("swap_pass_200k", lambda: swap_pass(first_lines(200_000), 50))

    # geometric median of one cluster holding all part points (BASELINE: median)
    one = part.select("coords", "weight", F.lit(0).alias("center_id"))
    start = {0: [float(v) for v in part.orderBy("point_id").first()["coords"]]}
    timed("median_part", lambda: W.geometric_medians(one, start, 2))
    timed("median_part_newton", lambda: W.geometric_medians(one, start, 2, method="newton"))

    # E1 cost and E2 assignment over all lineitem rows
    ctr = first_k_centers(part, 5)
    timed("cost_lineitem", lambda: A.clustering_cost_value(line, ctr))
    emb = EMBED.load(spark, sf_dir)
    ectr = first_k_centers(emb, 10)
    timed("assign_embeddings", lambda: A.assign_nearest(emb, ectr).agg(F.sum("distance")).collect())

    # W8 one refinement
    merged_part = persist(W.merge_duplicates(part))
    timed("refine_part", lambda: W.refine_once(merged_part, ctr, 2))
    timed("refine_part_plain", lambda: W.refine_once(merged_part, ctr, 2, method="weiszfeld"))

    # M1 whole runs
    timed("run_part", lambda: PL.cluster(part, 5, 20, 2).centers.collect())
    timed("run_lineitem", lambda: PL.cluster(line, 5, 600, 1).centers.collect())

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_wall", "value": total, "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
