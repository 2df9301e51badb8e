from pyspark.sql import functions as F

from helpers import ODD, no_docs, odd
from tessera.llm.language import folded, identify, training_rows


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    rows = identify(docs, training_rows(docs, 3, 1), held).join(docs, "doc_id").select("held_out", "lang", "lang_pred", "score").collect()
    mine = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(mine) > 1000 and sum(mine) >= 0.99 * len(mine)
    assert all(0 <= r.score <= 1 for r in rows)


def test_training_rows_are_not_held_out(spark):
    docs = odd(spark).withColumn("lang", F.when(F.col("doc_id") == 5, F.lit(None).cast("string")).otherwise(F.col("lang")))
    got = {r.doc_id for r in training_rows(docs, 3, 1).collect()}
    want = {r.doc_id for r in docs.where("doc_id IS NOT NULL AND doc_id <> 5 AND text IS NOT NULL").where(
        F.crc32(F.col("doc_id").cast("string")) % 3 != 1).collect()}
    assert got == want and got


def test_odd_rows(spark):
    train = spark.createDataFrame([(i, "de", "der die das und ist nicht ein mit") for i in range(20)]
                                  + [(50 + i, "en", "the and of this is not with one a") for i in range(20)], "doc_id INT, lang STRING, text STRING")
    got = identify(odd(spark), train, F.col("doc_id") == 5).collect()
    assert len(got) == len(ODD)
    for r in got:
        text = next(t for i, t in ODD if i == r.doc_id)
        if r.doc_id is not None:
            assert r.lang_pred == ("und" if r.doc_id in (1, 2, 3, 4) else r.lang_pred) and r.held_out == (r.doc_id == 5)
            assert r.lang_pred in ("und", "de", "en") and (r.lang_pred == "und") == (not text or not any(c.isalpha() for c in text))
    none = identify(odd(spark), no_docs(spark), F.lit(False)).collect()
    assert {r.lang_pred for r in none} == {"und"} and not any(r.accepted for r in none)
    assert identify(no_docs(spark), train, F.lit(True)).collect() == []


def test_folding():
    assert folded("Ab--C  \n é|É1") == "ab c é é".encode()
