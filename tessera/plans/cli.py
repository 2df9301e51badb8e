"""Command line: the same positional arguments and report as the reference's
driver, over the Spark clustering run.

    spark-submit tessera/plans/cli.py <master> <input> <cores> <tau> <k> <iterations> \
        [--seed N] [--out DIR]

``input`` is tab-separated text (file, directory or glob); ``cores`` is the
minimum number of input partitions. The report goes to stdout; ``--out``
also writes centers, assignments and metrics as parquet.
"""

from __future__ import annotations

import argparse
import os
import sys

if __name__ == "__main__" and __package__ in (None, ""):
    # run as a file (spark-submit): make the package importable
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession

# fixed values: the report lines, in the order they are printed
HEADER = "\n\n\n result for: {path} k:{k} tau: {tau}\n"
UNIFORM = "ug done, cell count: {cells} avg  numPointsPerCell:{avg}\n"
ADAPTIVE = "adaptive gridding done, num cells:{cells}\n"
SAMPLE = "sample size: {size}\n"
PHASE1 = "total cost after phase 1:{cost}\n"
PHASE2 = "total cost after phase 2 iteration:{it} : {cost}\n"


def _num(v: float) -> str:
    """Integral values print without a fraction, others as Python floats."""
    return str(int(v)) if float(v).is_integer() and abs(v) < 2 ** 53 else repr(float(v))


def report_lines(path: str, metrics: list[tuple]) -> list[str]:
    """The report as text lines from ``run_metrics`` rows."""
    m = {(p, i, name): v for p, i, name, v in metrics}
    out = [HEADER.format(path=path, k=_num(m[("grid", 0, "k")]), tau=_num(m[("grid", 0, "tau")])),
           UNIFORM.format(cells=_num(m[("grid", 0, "uniform_cells")]),
                          avg=repr(m[("grid", 0, "uniform_avg_per_cell")])),
           ADAPTIVE.format(cells=_num(m[("grid", 0, "adaptive_cells")])),
           SAMPLE.format(size=_num(m[("sample", 0, "sample_size")])),
           PHASE1.format(cost=repr(m[("phase1", 0, "cost")]))]
    its = sorted(i for p, i, name in m if p == "phase2" and name == "cost")
    out += [PHASE2.format(it=i, cost=repr(m[("phase2", i, "cost")])) for i in its]
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from tessera.plans.run import cluster, write_cluster_result
    from tessera.sources.points import read_points_text

    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("master")
    ap.add_argument("input")
    ap.add_argument("cores", type=int)
    ap.add_argument("tau", type=int)
    ap.add_argument("k", type=int)
    ap.add_argument("iterations", type=int)
    ap.add_argument("--seed", type=int, default=0)
    ap.add_argument("--out")
    args = ap.parse_args(argv)
    if spark is None:
        spark = SparkSession.builder.master(args.master).appName("tessera").getOrCreate()
    pts = read_points_text(spark, args.input, min_partitions=args.cores)
    res = cluster(pts, args.k, args.tau, args.iterations, seed=args.seed)
    for line in report_lines(args.input, res.metric_rows):
        sys.stdout.write(line + "\n")
    if args.out:
        write_cluster_result(res, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
