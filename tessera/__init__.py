"""Spark-native grid-sampled k-medoids and geometric-median clustering."""

import sys as _sys

try:
    # ship our functions to the Python workers inside the pickled closures, so
    # tasks run wherever the package is not on the workers' import path
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark without the hook
    pass

from tessera.operators.assign import assign_nearest, clustering_cost  # noqa: E402
from tessera.plans.run import cluster, write_cluster_result  # noqa: E402
from tessera.session import local_session  # noqa: E402
from tessera.sources.points import read_points_table, read_points_text  # noqa: E402

__all__ = ["assign_nearest", "cluster", "clustering_cost", "local_session", "read_points_table",
           "read_points_text", "write_cluster_result"]
