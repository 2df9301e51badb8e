"""A linear-chain conditional random field with two labels, for many chains at once.

Chains (the lines of texts) lie one after the other in arrays. Recursions run over
the position in the chain, on all chains that are that long together, so a batch of
texts costs as many array steps as its longest text has lines.

Label 1 scores ``x . w`` at a position and label 0 scores 0; ``trans[i, j]`` scores
label j after label i.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray

    def marginals(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(label 1) at every position, by forward-backward."""
        return _forward_backward(x @ self.weights, lengths, self.trans)[0]

    def viterbi(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The labels of the best path of every chain; of equal paths the one with label 1."""
        score = x @ self.weights
        order, first, active = _layout(lengths)
        n = len(score)
        best0, best1 = np.zeros(n), np.zeros(n)
        from0, from1 = np.zeros(n, bool), np.zeros(n, bool)
        t = self.trans
        for k, m in enumerate(active):
            at = first[:m] + k
            if k == 0:
                best1[at] = score[at]
                continue
            a, b = best0[at - 1], best1[at - 1]
            from0[at], from1[at] = b + t[1, 0] >= a + t[0, 0], b + t[1, 1] >= a + t[0, 1]
            best0[at] = np.maximum(a + t[0, 0], b + t[1, 0])
            best1[at] = score[at] + np.maximum(a + t[0, 1], b + t[1, 1])
        label = np.zeros(n, bool)
        last = (lengths[order] - 1) if len(order) else np.zeros(0, np.int64)
        for k in range(len(active) - 1, -1, -1):
            m = active[k]
            at = first[:m] + k
            ends = last[:m] == k
            now = best1[at] >= best0[at]
            if k + 1 < len(active):
                nxt = np.minimum(at + 1, n - 1)
                now = np.where(ends, now, np.where(label[nxt], from1[nxt], from0[nxt]))
            label[at] = now
        return label


def _layout(lengths: np.ndarray):
    """Chains from the longest: their order, first positions and how many reach each step."""
    lengths = np.asarray(lengths, np.int64)
    start = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    sizes = lengths[order]
    top = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(top), side="left")
    return order, start[order], active


def _forward_backward(score, lengths, trans):
    """Marginals of label 1 and of the four label pairs (per chain position after the first),
    and the log partition of all chains together. Scaled at every step."""
    order, first, active = _layout(lengths)
    n = len(score)
    e = np.exp(trans)
    # emission factors, the larger of the two being 1
    p1 = np.exp(np.minimum(score, 0.0))
    p0 = np.exp(-np.maximum(score, 0.0))
    f0, f1, b0, b1 = np.zeros(n), np.zeros(n), np.ones(n), np.ones(n)
    log_z = float(np.maximum(score, 0.0).sum())
    for k, m in enumerate(active):
        at = first[:m] + k
        if k == 0:
            a, b = p0[at], p1[at]
        else:
            x, y = f0[at - 1], f1[at - 1]
            a, b = (x * e[0, 0] + y * e[1, 0]) * p0[at], (x * e[0, 1] + y * e[1, 1]) * p1[at]
        z = a + b
        log_z += float(np.log(z).sum())
        f0[at], f1[at] = a / z, b / z
    for k in range(len(active) - 2, -1, -1):
        m = active[k + 1]
        at = first[:m] + k
        x, y = b0[at + 1] * p0[at + 1], b1[at + 1] * p1[at + 1]
        a, b = x * e[0, 0] + y * e[0, 1], x * e[1, 0] + y * e[1, 1]
        z = a + b
        b0[at], b1[at] = a / z, b / z
    g0, g1 = f0 * b0, f1 * b1
    marginal = g1 / (g0 + g1) if n else g1
    pair = np.zeros((2, 2))
    starts = np.zeros(n, bool)
    starts[first] = True
    at = np.flatnonzero(~starts)
    if len(at):
        q = [[f0[at - 1] * e[0, 0] * p0[at] * b0[at], f0[at - 1] * e[0, 1] * p1[at] * b1[at]],
             [f1[at - 1] * e[1, 0] * p0[at] * b0[at], f1[at - 1] * e[1, 1] * p1[at] * b1[at]]]
        total = q[0][0] + q[0][1] + q[1][0] + q[1][1]
        pair = np.array([[(q[i][j] / total).sum() for j in (0, 1)] for i in (0, 1)])
    return marginal, pair, log_z


def fit(x: np.ndarray, label: np.ndarray, lengths: np.ndarray, weight: np.ndarray | None = None,
        l2: float = 1e-3, steps: int = 200, rate: float = 0.1) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam. ``weight`` is a factor per position on
    the gradient of its emission (to balance labels)."""
    n, d = x.shape
    theta, m, v = np.zeros(d + 4), np.zeros(d + 4), np.zeros(d + 4)
    if not n:
        return Model(theta[:d], theta[d:].reshape(2, 2))
    w = np.ones(n) if weight is None else weight
    label = label.astype(float)
    starts = np.zeros(n, bool)
    starts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    at = np.flatnonzero(~starts)
    seen = np.array([[((label[at - 1] == i) & (label[at] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    for step in range(1, steps + 1):
        marginal, pair, _ = _forward_backward(x @ theta[:d], lengths, theta[d:].reshape(2, 2))
        g = np.r_[x.T @ (w * (marginal - label)), (pair - seen).ravel()] / n + l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(theta[:d], theta[d:].reshape(2, 2))
