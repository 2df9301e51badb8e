import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import ODD, no_docs, odd
from tessera.llm import textops as X
from tessera.llm.mixing import fit_domains, mix, rates_of, solve, texts_of
from tessera.llm.queries import TARGETS, label_domains

SF = "/root/testdata/sf0.01"


def members(spark, p, t):
    return spark.createDataFrame([(int(n), [float(v) for v in q]) for n, q in zip(t, p)], "n_tokens BIGINT, p ARRAY<DOUBLE>").repartition(3)


def test_totals_meet_the_targets(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = mix(docs, label_domains(labels), TARGETS).collect()
    p, t, r = (
        np.array([g.posteriors for g in got]), np.array([g.n_tokens for g in got], float), np.array([g.rate for g in got]))
    assert (r >= 0).all() and np.allclose(p.sum(axis=1), 1)
    names = sorted(TARGETS)
    want = np.array([TARGETS[n] for n in names]) / sum(TARGETS.values()) * 0.5 * t.sum()
    assert np.abs((p * (t * r)[:, None]).sum(axis=0) - want).max() <= 2e-6 * want.sum()


def test_solution_is_the_nonnegative_least_squares_one(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    t = rng.integers(1, 100, 400).astype(float)
    a, rows = (p * t[:, None]).T, members(spark, p, t).cache()
    w = np.linalg.inv((p * t[:, None]).T @ p)
    target = np.array([0.5, 0.3, 0.2]) * t.sum() * 0.4
    r = rates_of(p, t, 0.4, solve(rows, target, 0.4, enough=1e-9))
    g = p @ (w @ (a @ r - target))  # in the metric of the tokens
    assert (r >= 0).all() and np.abs(np.minimum(r, g)).max() < 1e-5
    # a target out of reach: every step comes nearer
    target = np.array([1.0, 0.0, 0.0]) * t.sum() * 2
    miss = [a @ rates_of(p, t, 0.4, s) - target for s in (solve(rows, target, 0.4, most=m) for m in (0, 3, 9))]
    loss = [m @ w @ m for m in miss]
    assert loss[0] > 4 * loss[1] > 4 * loss[2] * 0.5 and loss[1] > loss[2]


def test_classifier_tells_domains_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = mix(docs, label_domains(labels), TARGETS).join(label_domains(labels).withColumnRenamed("domain", "truth"), "doc_id").collect()
    assert sum(r.domain == r.truth for r in rows) >= 0.8 * len(rows)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(5, "x"), (5, "w"), (6, "y"), (None, "z"), (8, None), (8, "y")], "doc_id BIGINT, domain STRING")
    got = mix(odd(spark), labels, {"w": 1.0, "nowhere": 2.0}).collect()
    assert len(got) == len(ODD) and {r.domain for r in got} <= {"w", "y"}
    assert all(r.rate >= 0 and (r.n_tokens > 0 or r.rate == 0) for r in got)
    none = mix(odd(spark), labels.limit(0), {"w": 1.0}).collect()
    assert all(r.rate == 0 and r.domain is None and r.posteriors == [] for r in none) and len(none) == len(ODD)
    assert mix(no_docs(spark), labels, {"w": 1.0}).collect() == []
    assert mix(docs := odd(spark).where(F.col("text").isNull()), labels, {"w": 1.0}).count() == docs.count()


def test_rare_domains_keep_their_names_and_shares(spark):
    rows = [(i, "rare word here" if i < 3 else "other" if i < 2000 else "common text") for i in range(12_000)]
    docs = spark.createDataFrame([(i, t + " x" * (i % 5)) for i, t in rows] + [(20_000, "long " * 5000)], "doc_id BIGINT, text STRING")
    names = {"rare word here": "rare", "other": "some", "common text": "most"}
    # most labels are of documents that an earlier stage has taken out
    labels = spark.createDataFrame([(i, names[t]) for i, t in rows] + [(20_000, "long")] + [(i, "most") for i in range(30_000, 200_000)]
                                   + [(300_000, "gone")], "doc_id BIGINT, domain STRING")
    model = fit_domains(docs, labels)
    assert model.names == ["long", "most", "rare", "some"]
    data, offsets = X.buffers(pa.array(["", "rare word here"]))
    p, _ = model.posteriors(data, offsets)
    assert p[1, 2] > 20 * p[0, 2] and p[0, 1] > 0.7 > 0.01 > p[0, 2]  # what 3 of 12,001 texts can show
    assert texts_of({"a": 3, "b": 100, "c": 10_000, "d": 10_000}) == 1198 and texts_of({"a": 1 << 40}) == 2500 and texts_of({"a": 1}) >= 1
    with pytest.warns(UserWarning, match="gone"):
        mix(docs.limit(50), labels, {"most": 1.0, "gone": 1.0})
