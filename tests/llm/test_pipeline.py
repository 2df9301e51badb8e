import re

import corpus_pipeline as P
from helpers import ODD, no_docs, odd
from tessera.llm.secrets import RULES

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF).cache()
        if k < 4:
            assert out.columns == columns, name
            assert 0 < out.count() <= n
        n, docs = out.count(), out
        if name == "secret scans":
            assert not any(re.search(r"[0-9a-f]{32}", r.text) for r in out.collect()) and RULES
    assert P.run(spark, SF).count() == n


def test_odd_rows_go_through_every_stage(spark):
    for _, stage in P.STAGES:
        out = stage(spark, odd(spark), SF)
        assert out.count() <= len(ODD)
        assert stage(spark, no_docs(spark), SF).count() == 0
