import glob
import os
import random
import re

import pytest

from pyspark.sql import functions as F

from helpers import LONG, ODD, docs_of, no_docs, odd, words
from tessera.llm import ngram_join
from tessera.llm.ngram_join import jaccard_components, one_of_each
from tessera.llm.tables import written
from tessera.session import checkpoint, shared_dir


def brute(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    at = list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                at[root(a)] = root(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if root(b) == root(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), min(ids) if ids else None))
    return sorted(out, key=repr)


def corpus(seed, groups=12, copies=9):
    """Groups of near copies with edits of all strengths, shared lines, and short texts."""
    rng, rows = random.Random(seed), []
    shared = [" ".join(words(rng, 9)) for _ in range(3)]
    for _ in range(groups):
        base = words(rng, rng.choice([3, 8, 30, 90, 200]))
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            rows.append(" ".join(w) + ("\n" + rng.choice(shared) if rng.random() < 0.5 else ""))
    rows += [rng.choice(shared) + " " + rng.choice(shared) for _ in range(15)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,hot", [(1, 32), (2, 3), (3, 2), (4, 5)])
def test_components_equal_brute_force(spark, seed, hot):
    rows = corpus(seed)
    got = jaccard_components(docs_of(spark, rows).repartition(4), 4, 85, 100, hot).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 4, 85, 100)


def test_disk_holds_no_step_that_is_over(spark, monkeypatch):
    """Blocks are multiplied in rounds with the same result; what later steps don't read is gone."""
    monkeypatch.setattr(ngram_join, "ROUND_BYTES", 1)
    folder = shared_dir(spark).removeprefix("file:")
    rows, before = corpus(5), set(os.listdir(folder))
    got = jaccard_components(docs_of(spark, rows).repartition(4), 4, 85, 100, 4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 4, 85, 100)
    left = {x.split("-")[0] for x in set(os.listdir(folder)) - before}
    assert "classes" in left and not left & {"rows", "product", "pairs", "sets"}


def test_steps_leave_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def files():
        return {f for d in folders for f in glob.glob(f"{d.toString()}/*/shuffle_*")}

    before = files()
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert written(counts, "counts").count() == len(checkpoint(counts).collect()) == 7
    # counting itself may shuffle one row a task
    assert sum(map(os.path.getsize, files() - before)) < 1000
    assert counts.count() == 7


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(9)
    base = words(rng, 120)
    rows = [(i, " ".join(base[:j] + ["new"] + base[j:])) for i, j in enumerate([rng.randrange(120) for _ in range(150)])]
    rows += [(1000 + i, " ".join(words(rng, 50))) for i in range(40)]
    got = {r.doc_id: r.component_id for r in jaccard_components(docs_of(spark, rows), 4, 85, 100, 8).collect()}
    assert {got[i] for i in range(150)} == {0}
    assert all(got[i] == i for i in got if i >= 1000)


def test_odd_rows(spark):
    got = sorted((tuple(r) for r in jaccard_components(odd(spark), 4, 85, 100).collect()), key=repr)
    assert got == brute(ODD, 4, 85, 100)
    assert jaccard_components(no_docs(spark)).collect() == []


def test_one_of_each_keeps_one_row_a_component(spark):
    rows = [(3, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (9, "h i j k l m"), (9, "n o p q r s"),
            (None, "t u v w x y z"), (None, "t u v w x y z"), (4, ""), (4, ""), (5, None), (7, LONG), (8, LONG)]
    got = one_of_each(docs_of(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(
        [(2, "a b c d e f g"), (9, "h i j k l m"), (9, "n o p q r s"), (None, "t u v w x y z"), (4, ""), (4, ""), (5, None), (7, LONG)],
        key=repr)
    assert one_of_each(no_docs(spark)).collect() == []
    assert one_of_each(odd(spark)).columns == odd(spark).columns


def test_columns_named_as_the_keys_in_use(spark):
    rows = [(3, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (9, "h i j k l m"), (9, "n o p q r s"), (None, "t u v w x y z")]
    docs = docs_of(spark, rows)
    for c in ("_key", "_k0", "_k1", "__key", "_K0x"):
        docs = docs.withColumn(c, F.lit(7))
    got = one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r["_key"]) for r in got.collect()), key=repr) == sorted(
        [(2, "a b c d e f g", 7), (9, "h i j k l m", 7), (9, "n o p q r s", 7), (None, "t u v w x y z", 7)], key=repr)
