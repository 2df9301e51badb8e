import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helpers import ODD, no_docs, odd, words
from tessera.llm import crf
from tessera.llm import textops as X
from tessera.llm.lines import Lines
from tessera.llm.quality_classifier import classify, line_quality_model
from tessera.llm.quality_rules import keep, line_model, measures, quality_rules

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    inside = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_measures_equal_brute_force():
    rng = random.Random(2)
    rows = [t for _, t in ODD]
    for _ in range(300):
        w = [rng.choice([*words(rng, 3), "a#b", "é|", "\n", "\n\n", "\t", " x ", "same line\nsame line\n"]) for _ in range(rng.randint(0, 60))]
        rows.append(" ".join(w) + " " + " ".join(w[:20]) * rng.randint(0, 2))
    data, offsets = X.buffers(pa.array(rows))
    m = measures(Lines(data, offsets))
    assert list(zip(*(v.tolist() for v in m.values()))) == [brute(t) for t in rows]


def test_word_spans_and_hashes():
    data, offsets = X.buffers(pa.array(["a bb\tccc", "", None, "  ", "x" * 700 + " bb", "a"]))
    s, e, row = X.words(data, offsets)
    got = [bytes(data[a:b]).decode() for a, b in zip(s, e)]
    assert got == ["a", "bb", "ccc", "x" * 700, "bb", "a"] and row.tolist() == [0, 0, 0, 4, 4, 5]
    h = X.span_hashes(data, s, e)
    assert h[0] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 4


def test_chains_equal_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(0, 6, 4)
        x, model = rng.normal(size=(int(lengths.sum()), 3)), crf.Model(rng.normal(size=3) * 2, rng.normal(size=(2, 2)))
        p, best, at = model.marginals(x, lengths), model.viterbi(x, lengths), 0
        for n in lengths:
            s = x[at:at + n] @ model.weights
            paths = list(itertools.product((0, 1), repeat=int(n)))
            score = np.array([sum(s[i] * y for i, y in enumerate(q)) + sum(model.trans[a, b] for a, b in zip(q, q[1:])) for q in paths])
            z = np.exp(score) / np.exp(score).sum()
            for i in range(n):
                assert abs(p[at + i] - sum(w for w, q in zip(z, paths) if q[i])) < 1e-9
            if n:
                assert tuple(best[at:at + n].astype(int)) == paths[int(score.argmax())]
            at += n


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(4)
    lengths = np.array([3, 1, 0, 4])
    x, y, theta = rng.normal(size=(8, 2)), rng.integers(0, 2, 8), rng.normal(size=6)

    def loss(t):
        s, tr = x @ t[:2], t[2:].reshape(2, 2)
        gold, at = (s * y).sum(), 0
        for n in lengths:
            gold += sum(tr[a, b] for a, b in zip(y[at:at + n], y[at + 1:at + n]))
            at += n
        # label 1 scores s, label 0 scores 0
        return crf._forward_backward(s, lengths, tr)[2] - gold
    marginal, pair, _ = crf._forward_backward(x @ theta[:2], lengths, theta[2:].reshape(2, 2))
    starts = np.array([0, 3, 4])
    at = np.setdiff1d(np.arange(8), starts)
    seen = np.array([[((y[at - 1] == i) & (y[at] == j)).sum() for j in (0, 1)] for i in (0, 1)])
    g = np.r_[x.T @ (marginal - y), (pair - seen).ravel()]
    num = [(loss(theta + e) - loss(theta - e)) / 2e-6 for e in np.eye(6) * 1e-6]
    assert np.allclose(g, num, atol=1e-4)


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    got = classify(docs, line_quality_model(docs, labels.where(remainder != 0)), remainder == 0)
    rows = got.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    for q in (0, 1):
        mine = [r.predicted == q for r in rows if r.quality == q]
        assert sum(mine) >= 0.9 * len(mine) and mine
    assert all(0 <= r.score <= 1 for r in got.collect())


def test_rules_keep_good_and_reject_poor(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = line_model(docs, labels)
    got = quality_rules(docs, model)
    rows = got.join(labels, "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    assert sum(r.kept for r in rows if r.quality == 1) >= 0.97 * sum(r.quality == 1 for r in rows)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.1 * sum(r.quality == 0 for r in rows)
    kept = keep(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in got.where("kept").collect()}


def test_odd_rows(spark):
    docs = odd(spark)
    empty = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    for model in (line_model(docs, empty), line_quality_model(docs, empty)):
        assert len(model.weights) > 0
    got = quality_rules(docs, line_model(docs, empty)).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == \
        sorted(((i, *brute(t)) for i, t in ODD), key=repr)
    assert not any(r.kept for r in got if r.n_words == 0)
    scored = classify(docs, line_quality_model(docs, empty), F.lit(None).cast("boolean")).collect()
    assert len(scored) == len(ODD) and not any(r.held_out for r in scored) and all(abs(r.score - 0.5) < 1e-9 for r in scored)
    none = no_docs(spark)
    assert quality_rules(none, line_model(none, empty)).collect() == []
    assert classify(none, line_quality_model(none, empty), F.lit(True)).collect() == []
    assert keep(none, line_model(none, empty)).collect() == []
