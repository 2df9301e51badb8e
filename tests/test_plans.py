"""Plan properties of the registered queries: no cross joins anywhere, and
point scans read only the point columns."""

import pytest

from conftest import SF001
from tessera.operators import assign as A
from tessera.plans import queries as Q
from tessera.plans.fixtures import PART, first_k_centers

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _last_execution(store) -> int:
    """The highest execution id so far (the store keeps a bounded number, so its size says nothing)."""
    done = store.executionsList()
    return max((done.apply(i).executionId() for i in range(done.size())), default=-1)


@pytest.mark.parametrize("name", sorted(Q.REGISTRY))
def test_no_cross_join(spark, name):
    """Neither the returned plan nor that of any job run on the way has one."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = _last_execution(store)
    df = Q.REGISTRY[name](spark, SF001)
    plans = [df._jdf.queryExecution().executedPlan().toString()]
    done = store.executionsList()
    run = [done.apply(i) for i in range(done.size())]
    plans += [e.physicalPlanDescription() for e in run if e.executionId() > before]
    for plan in plans:
        assert not any(f in plan for f in FORBIDDEN), plan


def test_cost_scan_reads_only_point_columns(spark):
    pts = PART.load(spark, SF001)
    df = A.clustering_cost(pts, first_k_centers(pts, 3))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "p_size" in plan and "p_retailprice" in plan
    for col in ("p_partkey", "p_name", "p_brand", "p_type"):
        assert col not in plan
    assert "partial_sum" in plan
