"""A two-state linear-chain conditional random field in numpy.

Many sequences are handled as one array; ``start`` marks where each begins.
Forward and backward messages are computed by a blocked scan: products of 2 x 2
step matrices over fixed-length blocks, a short pass over the block products,
and a second pass inside the blocks.  The result is exact and its cost does not
depend on how long a single sequence is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BLOCK = 64


def _messages(e0, e1, start, trans, init):
    """Normalised forward and backward messages, each (n, 2).

    ``e0``, ``e1``: positive emission potentials; ``trans``: positive 2 x 2;
    ``init``: positive 2.  A start step forgets what came before.
    """
    n = len(e0)
    width = -(-n // _BLOCK)
    pad = width * _BLOCK - n

    def grid(x, fill):
        return np.ascontiguousarray(np.concatenate((x, np.full(pad, fill, dtype=x.dtype))).reshape(width, _BLOCK).T)

    g0, g1, gs = grid(e0, 1.0), grid(e1, 1.0), grid(start, True)
    # step matrix m[a][b]: from state a before to state b at the step
    m00 = np.where(gs, init[0], trans[0, 0]) * g0
    m01 = np.where(gs, init[1], trans[0, 1]) * g1
    m10 = np.where(gs, init[0], trans[1, 0]) * g0
    m11 = np.where(gs, init[1], trans[1, 1]) * g1
    p00, p01, p10, p11 = m00[0].copy(), m01[0].copy(), m10[0].copy(), m11[0].copy()
    for t in range(1, _BLOCK):
        a, b, c, d = m00[t], m01[t], m10[t], m11[t]
        p00, p01 = p00 * a + p01 * c, p00 * b + p01 * d
        p10, p11 = p10 * a + p11 * c, p10 * b + p11 * d
        z = 1.0 / (p00 + p01 + p10 + p11)
        p00, p01, p10, p11 = p00 * z, p01 * z, p10 * z, p11 * z
    f0, f1 = np.empty(width), np.empty(width)
    x, y = 0.5, 0.5
    for i, (a, b, c, d) in enumerate(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist(), strict=True)):
        f0[i], f1[i] = x, y
        x, y = x * a + y * c, x * b + y * d
        z = x + y
        x, y = x / z, y / z
    b0, b1 = np.empty(width), np.empty(width)
    x, y = 0.5, 0.5
    for i in range(width - 1, -1, -1):
        b0[i], b1[i] = x, y
        x, y = p00[i] * x + p01[i] * y, p10[i] * x + p11[i] * y
        z = x + y
        x, y = x / z, y / z
    fw0, fw1 = np.empty((_BLOCK, width)), np.empty((_BLOCK, width))
    x, y = f0, f1
    for t in range(_BLOCK):
        x, y = x * m00[t] + y * m10[t], x * m01[t] + y * m11[t]
        z = 1.0 / (x + y)
        x, y = x * z, y * z
        fw0[t], fw1[t] = x, y
    bw0, bw1 = np.empty((_BLOCK, width)), np.empty((_BLOCK, width))
    x, y = b0, b1
    for t in range(_BLOCK - 1, -1, -1):
        bw0[t], bw1[t] = x, y
        x, y = m00[t] * x + m01[t] * y, m10[t] * x + m11[t] * y
        z = 1.0 / (x + y)
        x, y = x * z, y * z

    def flat(u):
        return u.T.reshape(-1)[:n]

    return flat(fw0), flat(fw1), flat(bw0), flat(bw1)


def marginals(score: np.ndarray, start: np.ndarray, trans: np.ndarray, init: np.ndarray) -> np.ndarray:
    """P(state 1) of every step.  ``score``: log-potential of state 1 over state 0."""
    if not len(score):
        return np.zeros(0)
    e1 = np.exp(np.clip(score, -30, 30))
    a0, a1, b0, b1 = _messages(np.ones(len(score)), e1, start, np.exp(trans), np.exp(init))
    one = a1 * b1
    return one / (one + a0 * b0)


@dataclass
class Model:
    """Weights of sparse indicator features (column: feature id) for state 1."""

    weights: np.ndarray
    bias: float
    trans: np.ndarray
    init: np.ndarray


def emission(features: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """``features``: (n, slots) feature ids, -1 for none."""
    padded = np.append(weights, 0.0)
    return padded[features].sum(axis=1) + bias


def train(features: np.ndarray, labels: np.ndarray, start: np.ndarray, n_features: int, *, steps: int = 40, rate: float = 0.5, l2: float = 1e-3) -> Model:
    """Maximum conditional likelihood by full-batch Adam; deterministic."""
    n = max(1, len(labels))
    base = (labels.sum() + 1.0) / (n + 2.0)
    weights, bias = np.zeros(n_features), float(np.log(base / (1 - base)))
    trans, init = np.zeros((2, 2)), np.zeros(2)
    if not len(labels):
        return Model(weights, bias, trans, init)
    inner = ~start
    inner[0] = False
    at = np.flatnonzero(inner)
    prev = at - 1
    y = labels.astype(np.int64)
    seen_t = np.bincount(y[prev] * 2 + y[at], minlength=4).reshape(2, 2).astype(float)
    seen_i = np.bincount(y[start], minlength=2).astype(float)
    flat_valid = [features[:, j] >= 0 for j in range(features.shape[1])]
    param = np.concatenate((weights, [bias], trans.ravel(), init))
    m, v = np.zeros_like(param), np.zeros_like(param)
    for step in range(1, steps + 1):
        weights, bias = param[:n_features], param[n_features]
        trans, init = param[n_features + 1 : n_features + 5].reshape(2, 2), param[n_features + 5 :]
        score = emission(features, weights, bias)
        e1 = np.exp(np.clip(score, -30, 30))
        et = np.exp(trans)
        a0, a1, b0, b1 = _messages(np.ones(n), e1, start, et, np.exp(init))
        p = a1 * b1 / (a1 * b1 + a0 * b0)
        residual = y - p
        grad = np.zeros(n_features)
        for j, valid in enumerate(flat_valid):
            grad += np.bincount(features[valid, j], weights=residual[valid], minlength=n_features)
        x = [a0[prev] * et[0, 0] * b0[at], a0[prev] * et[0, 1] * e1[at] * b1[at], a1[prev] * et[1, 0] * b0[at], a1[prev] * et[1, 1] * e1[at] * b1[at]]
        z = x[0] + x[1] + x[2] + x[3]
        expect = np.array([(u / z).sum() for u in x]).reshape(2, 2)
        expect_i = np.array([(1 - p[start]).sum(), p[start].sum()])
        g = np.concatenate((grad, [residual.sum()], (seen_t - expect).ravel(), seen_i - expect_i)) / n - l2 * 1e-2 * param
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        param = param + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) / (1 + 0.05 * step)
    return Model(param[:n_features].copy(), float(param[n_features]), param[n_features + 1 : n_features + 5].reshape(2, 2).copy(), param[n_features + 5 :].copy())


def logistic(x: np.ndarray, y: np.ndarray, *, l2: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (bias last) of an L2-regularised logistic regression by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    penalty = np.diag([l2] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty @ w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        d = np.linalg.solve(h, g)
        w = w - d
        if np.abs(d).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
