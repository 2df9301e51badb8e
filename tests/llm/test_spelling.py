import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from helpers import ODD, docs_of, no_docs, odd
from tessera.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(docs, least_chars=7, least_n=2, every=31):
    c = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(x.lower() if x.isascii() else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least_chars:
                c[run] += 1
    return {w: n for w, n in c.items() if n >= least_n}


def brute_near(words):
    """{word: its near words} by every word with one code point less."""
    less = {}
    for w in words:
        for i in range(len(w)):
            less.setdefault((i, w[:i] + w[i + 1:]), set()).add(w)
    out = {w: set() for w in words}
    for (_, s), group in less.items():
        for w in group:
            out[w] |= group - {w}
            if s in out:
                out[w].add(s)
                out[s].add(w)
    return out


def brute(docs, **kw):
    n = brute_counts(docs, **kw)
    near, rows, form = brute_near(n), {}, {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        if top and n[top] >= 10 * n[w]:
            form[w] = top
    for w in n:
        root = w
        while root in form:
            root = form[root]
        rows[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return rows


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def pairs(spark, words):
    rows = S.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word STRING, n INT")).collect()
    out = {w: set() for w in words}
    for r in rows:
        assert r.near not in out[r.word]
        out[r.word].add(r.near)
    return out


@pytest.mark.parametrize("seed,alphabet,low,high", [(1, "ab", 1, 7), (2, "abé", 1, 6), (3, "aàbÿ×", 7, 9), (4, "a", 1, 40)])
def test_near_pairs_equal_brute_force(spark, seed, alphabet, low, high):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(400)})
    assert pairs(spark, words) == brute_near(words)


def test_long_words(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghij") for _ in range(20_000))
    words = [base, base[:-1], base[:5] + base[6:], base[:15_000] + "zz" + base[15_000:], base[:10_000] + "z" + base[10_001:], base + "q", "z" + base]
    want = {w: {v for v in words if v != w and one_edit(w, v)} for w in words}
    assert pairs(spark, words) == want


def one_edit(w, v):
    if len(w) > len(v):
        w, v = v, w
    i = next((i for i, (a, b) in enumerate(zip(w, v)) if a != b), len(w))
    return len(v) - len(w) < 2 and w[i + (len(w) == len(v)):] == v[i + 1:]


def test_checksums():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 300)
    ends = starts + rng.integers(0, 200, 300)
    before = rng.integers(0, 1 << 32, 300).astype(np.uint32)
    want = [zlib.crc32(data[s:e].tobytes(), int(b)) for s, e, b in zip(starts, ends, before)]
    assert S.checksums(data, starts, ends, before).tolist() == want


def test_variants_equal_brute_force(spark):
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdéÿ") for _ in range(rng.randint(6, 9))) for _ in range(30)]

    def word():
        w = stems[min(int(rng.expovariate(0.2)), 29)]
        while rng.random() < 0.06:
            i = rng.randrange(len(w))
            w = w[:i] + rng.choice(["", "a", "b" + w[i]]) + w[i + 1:]
        return w if rng.random() < 0.9 else w.upper()
    docs = [(i, rng.choice([" ", ", ", "-1", "ł"]).join(word() for _ in range(150))) for i in range(60)]
    docs.append((99, " ".join(["planetary"] * 300 + ["planetery"] * 25 + ["planeterx"] * 2)))
    want = brute(docs)
    assert got(S.variants(docs_of(spark, docs))) == want
    assert sum(f is not None for f, *_ in want.values()) > 20
    assert any(f is not None and root != f for f, root, *_ in want.values())   # chains of several forms


def test_no_table_is_broadcast_by_its_estimated_size(spark):
    """The driver holds no table that grows with the vocabulary: small files can hold many rows."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcd") for _ in range(8)) for _ in range(40)]
    docs = docs_of(spark, [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(20)])
    store = spark._jsparkSession.sharedState().statusStore()

    def jobs():
        done = store.executionsList()
        return {e.executionId(): e.physicalPlanDescription() for e in (done.apply(i) for i in range(done.size()))}

    before = max(jobs(), default=-1)
    S.variants(docs).collect()
    plans = [plan for k, plan in jobs().items() if k > before]
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastExchange" in p for p in plans)


def test_odd_rows(spark):
    texts = [*ODD, (11, "lettered lettered Lettered letterred"), (12, "x" * 3000), (12, "x" * 3000), (13, "x" * 2999 + " " + "x" * 2999)]
    from pyspark.sql import functions as F
    docs = odd(spark).unionByName(docs_of(spark, texts[len(ODD):]).select("*", *[F.lit("x").alias(c) for c in odd(spark).columns[5:]]))
    assert got(S.variants(docs)) == brute(texts)
    assert S.variants(no_docs(spark)).collect() == []
    assert S.variants(docs_of(spark, [(1, None), (2, "short")])).collect() == []
