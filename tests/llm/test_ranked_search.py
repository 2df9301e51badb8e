import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import ODD, docs_of, no_docs, odd, words
from tessera.llm import ranked_search as R

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k):
    """(item, rank, doc, score) by scoring every document."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    N, L = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            if bag:
                m = 100 - 25 + 25 * sum(bag.values()) * N // L
                s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                        for t in terms(text) if t in bag)
                if s > 0:
                    scored.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def items_of(spark, pairs):
    return spark.createDataFrame(pairs, "item_id BIGINT, text STRING").withColumn("rank", F.lit("x")).withColumn("doc_id", F.lit("x"))


@pytest.mark.parametrize("seed,k,block,first,shard", [(1, 20, 1 << 20, 64, 8192), (2, 3, 40, 2, 64), (3, 5, 300, 1, 64), (4, 500, 1 << 20, 4, 128)])
def test_equals_scoring_every_document(spark, monkeypatch, seed, k, block, first, shard):
    monkeypatch.setattr(R, "FIRST_READ", first)
    monkeypatch.setattr(R, "SHARD_DOCS", shard)
    rng = random.Random(seed)
    vocabulary = words(rng, 60, 2) + ["Éa", "éa", "x1", "漢字"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(250)]
    docs = [(i, texts[i % 200]) for i in range(250)] + [(7, texts[3]), (None, texts[4])]
    items = [(i, "-".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))) for i in range(12)] + [(3, "ba BA ba"), (99, "unknownterm")]
    got = rows(R.ranked(docs_of(spark, docs).repartition(3), items_of(spark, items), k, block))
    assert got == brute(docs, items, k)


def test_nra_resolves_members_ties_and_scores(monkeypatch):
    monkeypatch.setattr(R, "FIRST_READ", 1)
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, m, k = int(rng.integers(1, 40)), int(rng.integers(1, 6)), int(rng.integers(1, 8))
        lists, first, count, score = [], [], [], np.zeros(n, np.int64)
        repeats = rng.integers(1, 3, m)
        for i in range(m):
            d = rng.permutation(n)[:int(rng.integers(1, n + 1))]
            w = np.sort(rng.integers(1, 6, len(d)))[::-1]
            first.append(sum(len(x[0]) for x in lists))
            count.append(len(d))
            lists.append((d, w))
            np.add.at(score, d, w * repeats[i])
        floor = int(rng.integers(0, 12))
        want = sorted((-s, d) for d, s in enumerate(score.tolist()) if s > 0 and s >= floor)[:k]
        d, s = R.nra(np.array(first), np.array(count), repeats, np.concatenate([x[0] for x in lists]),
                     np.concatenate([x[1] for x in lists]), n, k, floor)
        assert list(zip((-s).tolist(), d.tolist())) == want


def test_nra_stops_before_the_lists_end():
    """Far documents that cannot reach the floor are left unread."""
    n = 100_000
    docs, impacts = np.arange(n), np.arange(n, 0, -1)
    reads = CountedReads(impacts)
    best, score = R.nra(np.array([0]), np.array([n]), np.array([1]), docs, reads, n, 3)
    assert best.tolist() == [0, 1, 2] and score.tolist() == [n, n - 1, n - 2]
    assert reads.read < 1000


class CountedReads:
    def __init__(self, values):
        self.values, self.read = values, 0

    def __getitem__(self, at):
        self.read += np.size(at)
        return self.values[at]


def test_blocks_hold_their_bytes(spark):
    rng = random.Random(2)
    texts = [(str(i), "x" * rng.randint(1, 50)) for i in range(200)] + [("long", "y" * 1000)]
    dealt, blocks = R.query_blocks(spark.createDataFrame(texts, "_query STRING, text STRING"), 100)
    sizes = {}
    for r in dealt.collect():
        sizes.setdefault(r["_block"], []).append(len(r.text))
    assert sorted(sizes) == blocks and sum(map(len, sizes.values())) == 201
    assert all(sum(s) <= 100 or len(s) == 1 for s in sizes.values())


def test_odd_rows(spark):
    items = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "漢字 some"), (4, "a"), (5, "...")]
    got = rows(R.ranked(odd(spark), items_of(spark, items)))
    assert got == brute(ODD, items, 20)
    assert R.ranked(no_docs(spark), items_of(spark, items)).collect() == []
    assert R.ranked(odd(spark), items_of(spark, items).limit(0)).collect() == []


def test_ids_of_other_types(spark):
    docs = docs_of(spark, [(1, "alpha beta"), (2, "alpha alpha"), (3, "gamma")]).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    got = R.ranked(docs, items_of(spark, [(1, "alpha")]).withColumn("item_id", F.col("item_id").cast("decimal(9,0)"))).collect()
    assert sorted((r["rank"], r.doc_id) for r in got) == [(1, "d2"), (2, "d1")]
