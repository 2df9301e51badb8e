"""Mixing sources to target weights: soft membership and projected gradients.

A classifier fitted on a labelled table gives every document posteriors over domains.
Documents get nonnegative rates r such that the expected tokens of each domain,
``sum_d r_d tokens_d p_dk``, come as near to its target as least squares can:

    minimise 1/2 (A r - T)' W (A r - T),  r >= 0,   A_kd = tokens_d p_dk

W is the inverse of ``M = sum_d tokens_d p_d p_d'``, so that a rare domain converges as
fast as a common one. In the metric of the tokens a projected gradient step is
``r_d <- max(0, r_d - p_d . W (A r - T))``: it depends on the document's posteriors and
one vector a step, so a pass over the documents replays the steps so far and returns
one vector of domain totals. Nothing but such vectors reaches the driver.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textops as X
from tessera.llm.tables import type_of, written

#: hashed words of the classifier, labelled texts (about) it is fitted on, those of a domain that has as many,
#: and characters of each
BUCKETS, SAMPLE_TEXTS, LEAST_TEXTS, SAMPLE_CHARS = 1 << 16, 2500, 50, 20_000
STEPS, RATE, PENALTY = 100, 0.3, 1e-4


def _bags(data: np.ndarray, offsets: np.ndarray):
    """Hashed lower-case words: (bucket, row) of every word, and words of every row."""
    low = X.LOWER[data]
    s, e, row = X.words(low, offsets)
    return (X.span_hashes(low, s, e) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1), row, \
        np.bincount(row, minlength=len(offsets) - 1)


class Domains:
    """Softmax regression on hashed words; a text's words weigh 1 / sqrt(their number)."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray):
        self.names, self.weights, self.bias = names, weights.astype(np.float32), bias

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors (row, domain) and words of every text."""
        at, row, n = _bags(data, offsets)
        z = np.column_stack([np.bincount(row, weights=self.weights[at, k], minlength=len(n)) for k in range(len(self.names))]) \
            if self.names else np.zeros((len(n), 0))
        return _softmax(z / np.sqrt(np.maximum(n, 1))[:, None] + self.bias), n


def _softmax(z: np.ndarray) -> np.ndarray:
    if not z.shape[1]:
        return z
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def texts_of(counts: dict[str, int]) -> int:
    """The most texts to draw of a domain by which all draw SAMPLE_TEXTS together: small domains give all
    they have, the others alike, at least LEAST_TEXTS."""
    left, most = SAMPLE_TEXTS, 0
    for k, n in enumerate(sorted(counts.values())):
        most = left // (len(counts) - k)
        if n > most:
            break
        left -= n
    return max(most, LEAST_TEXTS)


def fit_domains(docs: DataFrame, labels: DataFrame) -> Domains:
    """A classifier from ``labels(doc_id, domain)``. The domains and their shares are those of all
    labelled documents that have a text; the words are weighed on a bounded sample: of each domain
    about ``texts_of`` texts, cut to SAMPLE_CHARS characters, those whose id has the lowest hash. A
    repeated id counts once, with its first domain by name; null ids and domains don't."""
    rows = labels.where("domain IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    rows = written(rows.join(docs.where("text IS NOT NULL").select("doc_id").distinct(), "doc_id"), "labelled")
    counts = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    if not names:
        return Domains([], np.zeros((BUCKETS, 0)), np.zeros(0))
    most = texts_of(counts)
    below = docs.sparkSession.createDataFrame([(d, min(1.0, most / n) * (1 << 30)) for d, n in counts.items()], "domain STRING, below DOUBLE")
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    some = rows.join(F.broadcast(below), "domain").where(order < F.col("below")).select("doc_id", "domain")
    found = (docs.where("text IS NOT NULL").select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
             .join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("domain").alias("domain")).collect())
    found.sort(key=lambda r: r["doc_id"])
    data, offsets = X.buffers(pa.array([r["text"] for r in found], pa.string()))
    at, row, n_words = _bags(data, offsets)
    scale = 1 / np.sqrt(np.maximum(n_words, 1))
    y = np.zeros((len(found), len(names)))
    y[np.arange(len(found)), [names.index(r["domain"]) for r in found]] = 1
    share = np.array([counts[n] for n in names]) / sum(counts.values())
    balance = (y / np.maximum(y.mean(axis=0), 1 / len(found))).sum(axis=1)  # all domains weigh alike while fitting; the bias then gets their shares
    w, b = np.zeros((BUCKETS, len(names))), np.zeros(len(names))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.column_stack([np.bincount(row, weights=w[at, k], minlength=len(found)) for k in range(len(names))])
        err = (_softmax(z * scale[:, None] + b) - y) * balance[:, None] / len(names)
        g = np.column_stack([np.bincount(at, weights=(err[:, k] * scale)[row], minlength=BUCKETS) for k in range(len(names))])
        g = g / len(found) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6) * 0.1
        b -= RATE * err.mean(axis=0)
    return Domains(names, w, b + np.log(share))


def _posterior_fn(model: Domains):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in X.text_slices(batch):
                p, n = model.posteriors(data, offsets)
                k = len(model.names)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * k), pa.array(p.ravel()))],
                    ["doc_id", "n_tokens", "p"])
    return run


def _matrix(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return p, batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)


def rates_of(p: np.ndarray, tokens: np.ndarray, start: float, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps; a document without tokens has rate 0."""
    r = np.full(len(p), start)
    for v in steps:
        r = np.maximum(0.0, r - p @ v)
    return np.where(tokens > 0, r, 0.0)


def _sums_fn(k: int, start: float, steps: list[np.ndarray] | None):
    """Per batch: the moments M (no steps given), or the expected tokens of each domain."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p, t = _matrix(batch, k)
                x = (p * t[:, None]).T @ p if steps is None else (p * (t * rates_of(p, t, start, steps))[:, None]).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.size, dtype=np.int32)), pa.array(x.ravel())], ["at", "x"])
    return run


def _totals(members: DataFrame, k: int, size: int, start: float, steps) -> np.ndarray:
    rows = members.select("n_tokens", "p").mapInArrow(_sums_fn(k, start, steps), "at INT, x DOUBLE")
    out = np.zeros(size)
    for r in rows.groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out


def solve(members: DataFrame, targets: np.ndarray, start: float, most: int = 60, enough: float = 1e-6) -> list[np.ndarray]:
    """Projected gradient steps for ``members(n_tokens, p)`` until the totals miss the targets by
    ``enough`` of their sum, no step changes them any more, or ``most`` steps are done."""
    k = len(targets)
    moment = _totals(members, k, k * k, start, None).reshape(k, k)
    weight = np.linalg.inv(moment + np.eye(k) * max(1e-9 * np.trace(moment), 1e-12))
    steps: list[np.ndarray] = []
    before = None
    for _ in range(most):
        total = _totals(members, k, k, start, steps)
        miss = total - targets
        if np.abs(miss).max() <= enough * max(targets.sum(), 1.0):
            break
        if before is not None and np.abs(total - before).max() <= 1e-3 * enough * max(targets.sum(), 1.0):
            break
        before = total
        steps.append(weight @ miss)
    return steps


def _rate_fn(names: list[str], start: float, steps: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            p, t = _matrix(batch, len(names)) if names else (np.zeros((batch.num_rows, 0)), np.zeros(batch.num_rows))
            best = p.argmax(axis=1) if names else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_tokens"), batch.column("p"),
                 pa.array([names[i] for i in best] if names else [None] * batch.num_rows, pa.string()),
                 pa.array(rates_of(p, t, start, steps) if names else np.zeros(batch.num_rows))],
                ["doc_id", "n_tokens", "posteriors", "domain", "rate"])
    return run


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], share: float = 0.5) -> DataFrame:
    """Rates for ``docs(doc_id, text, ...)`` by which domain token totals meet ``weights``.

    The totals' sum is ``share`` of all words. Domains are those of the labelled table,
    by name; one without a weight has target 0, a weight without a labelled domain can't
    be met: a warning names it and the others share its part. Returns (doc_id, n_tokens, posteriors, domain, rate): words,
    posteriors in the order of the names, the likeliest domain, and the rate. A null or
    empty text has no tokens, the domains' shares as posteriors and rate 0; without a
    labelled text there are no domains and every rate is 0. One result row per input
    row; other columns are ignored."""
    model = fit_domains(docs, labels)
    if without := sorted(n for n, w in weights.items() if w > 0 and n not in model.names):
        warnings.warn(f"no labelled text for the targets {', '.join(without)}; the others share their part", stacklevel=2)
    kind = type_of(docs, "doc_id")
    members = written(docs.select("doc_id", "text").mapInArrow(
        _posterior_fn(model), f"doc_id {kind}, n_tokens BIGINT, p ARRAY<DOUBLE>"), "members")
    steps: list[np.ndarray] = []
    if model.names:
        wanted = np.array([weights.get(n, 0.0) for n in model.names])
        tokens = members.agg(F.sum("n_tokens")).first()[0] or 0
        targets = wanted / max(wanted.sum(), 1e-12) * share * tokens
        steps = solve(members, targets, share)
    schema = f"doc_id {kind}, n_tokens BIGINT, posteriors ARRAY<DOUBLE>, domain STRING, rate DOUBLE"
    return members.mapInArrow(_rate_fn(model.names, share, steps), schema)
