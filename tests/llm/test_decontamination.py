import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import LONG, ODD, docs_of, no_docs, odd, words
from tessera.llm import decontamination as D


def items_and_texts(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(words(rng, rng.choice([1, 4, 12, 30, 60]))) + ". " + " ".join(words(rng, rng.choice([1, 5, 12]))) + ".")
             for i in range(40)]
    texts = []
    for k in range(120):
        w = words(rng, rng.choice([0, 20, 300]))
        at = rng.randrange(len(w) + 1)
        piece = rng.choice(items)[1]
        if k % 4 == 0:
            piece = piece.upper()
        if k % 4 == 1:  # a part only
            piece = " ".join(piece.split()[:len(piece.split()) // 3])
        if k % 4 == 2:
            p = piece.split()
            p[rng.randrange(len(p))] = "zzz"
            piece = " ".join(p)
        texts.append(" ".join(w[:at]) + (" " + piece + " " if k % 5 else " ") + " ".join(w[at:]))
    return items, list(enumerate(texts))


def exhaustive(index, h):
    """All passages against all items, with full scores and the same verification."""
    best, half = {}, index.window // 2
    for p in range(max(1, -(-len(h) // half))):
        part = h[p * half:p * half + index.window]
        for i, item in enumerate(index.items):
            score = sum(x for w in set(part.tolist()) if w in index.lists
                        for j, x in zip(index.lists[w].items, index.lists[w].impacts) if j == i)
            if score >= D.LEAST_SCORE - 1e-12:
                q, a = D.covered(item.question, part, D.SHINGLE), D.covered(item.answer, part, 3)
                if q >= D.LEAST_QUESTION and a >= D.LEAST_ANSWER:
                    best.setdefault(i, set()).add(p)
    return set(best)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_retrieval_equals_exhaustive_scoring(spark, seed):
    items, texts = items_and_texts(seed)
    table = spark.createDataFrame(items, "item_id INT, text STRING")
    index, = D.indexes(table)
    want = {(i, index.items[j].id) for i, t in texts for j in exhaustive(index, D.hashes_of(t))}
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs_of(spark, texts), table).collect()}
    assert got == want and len(got) > 20
    clean = {r.doc_id for r in D.clean(docs_of(spark, texts), table).collect()}
    assert clean == {i for i, _ in texts} - {i for i, _ in want}


def test_search_finds_all_items_above_any_threshold(spark):
    items, texts = items_and_texts(7)
    index, = D.indexes(spark.createDataFrame(items, "item_id INT, text STRING"))
    for _, t in texts[:60]:
        w = np.unique(D.hashes_of(t))
        score = np.zeros(len(index.items))
        for x in w.tolist():
            if x in index.lists:
                for j, v in zip(index.lists[x].items, index.lists[x].impacts):
                    score[j] += v
        for least in (0.05, 0.2, 0.5, 0.9):
            got = dict(index.search(w, least))
            assert set(got) == set(np.flatnonzero(score >= least - 1e-12).tolist())
            assert all(abs(got[j] - score[j]) < 1e-9 for j in got)


def test_several_indexes_find_the_same(spark, monkeypatch):
    items, texts = items_and_texts(4)
    table, docs = spark.createDataFrame(items, "item_id INT, text STRING"), docs_of(spark, texts)
    one = {(r.doc_id, r.item_id) for r in D.contaminated(docs, table).collect()}
    monkeypatch.setattr(D, "INDEX_BYTES", 2000)
    assert len(D.indexes(table)) > 2
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, table).collect()} == one


def test_every_planted_item_is_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), r"[\W_]+", " ")), F.lit(" "))
    both = docs.select("doc_id", plain.alias("t")).join(F.broadcast(bench.select("item_id", plain.alias("i"))), F.expr("contains(t, i)"))
    want = {(r.doc_id, r.item_id) for r in both.collect()}
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert want and want <= got and len({d for d, _ in got}) <= len({d for d, _ in want}) + 2


def test_odd_rows(spark):
    items = spark.createDataFrame([("a", None, 1), ("b", "", 1), ("c", " . ", 1), ("d", LONG[:4000], 1), ("d", LONG[:4000], 1),
                                   ("e", "a text without an id, of some words at least", 1)], "item_id STRING, text STRING, doc_id INT")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(odd(spark), items).collect()}
    assert got == {(7, "d"), (None, "e")}
    left = D.clean(odd(spark), items)
    assert left.columns == odd(spark).columns and left.count() == len(ODD) - 3
    assert D.contaminated(no_docs(spark), items).collect() == []
    empty = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert D.contaminated(odd(spark), empty).collect() == [] and D.clean(odd(spark), empty).count() == len(ODD)


def test_item_ids_of_any_type(spark):
    items = spark.createDataFrame([(1, "a text without an id, of some words at least"), (2, "nowhere to be found in any document of these")], "item_id INT, text STRING")
    for kind in ("smallint", "decimal(12,2)", "double", "date", "binary"):
        cast = F.col("item_id").cast(kind) if kind != "date" else F.date_add(F.lit("2020-01-01").cast("date"), F.col("item_id"))
        typed = items.select(cast.alias("item_id") if kind != "binary" else F.col("item_id").cast("string").cast("binary").alias("item_id"), "text")
        want = typed.where(F.col("text").startswith("a text")).first()["item_id"]
        assert [(r.doc_id, r.item_id) for r in D.contaminated(odd(spark), typed).collect()] == [(None, want)]
