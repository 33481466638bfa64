"""Linear-chain conditional random fields over many sequences at once.

Sequences are cut into blocks of equal length.  Transfer matrices of all blocks are multiplied up side by side, vectors
are passed from block to block, and then every block is finished side by side, so the number of array operations does
not follow the longest sequence."""

from __future__ import annotations

import numpy as np

BLOCK = 32


def marginals(emit: np.ndarray, lens: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Forward-backward.  emit: log scores (tokens, labels) of the sequences end to end; lens: tokens of each sequence.
    Returns the label probabilities of each token, and with `pairs` also the expected number of each transition."""
    n, k = emit.shape
    if n == 0:
        return np.zeros((0, k)), np.zeros((k, k))
    lens = lens[lens > 0]
    blocks = -(-lens // BLOCK)
    order = np.argsort(-blocks, kind="stable")
    first_block = np.zeros(len(lens), np.int64)
    first_block[1:] = np.cumsum(blocks)[:-1]
    nb = int(blocks.sum())
    seq_start = np.zeros(len(lens), np.int64)
    seq_start[1:] = np.cumsum(lens)[:-1]
    pos = np.arange(n) + np.repeat(first_block * BLOCK - seq_start, lens)

    e = np.ones((nb * BLOCK, k), np.float32)
    e[pos] = np.exp(np.maximum(emit - emit.max(1, keepdims=True), -40.0))
    real = np.zeros(nb * BLOCK, bool)
    real[pos] = True
    e, real = e.reshape(nb, BLOCK, k), real.reshape(nb, BLOCK)
    a = np.exp(trans - trans.max()).astype(np.float32)
    s = np.exp(start - start.max()).astype(np.float32)
    heads = np.zeros(nb, bool)
    heads[first_block] = True

    # transfer matrix of each block
    prod = np.broadcast_to(np.eye(k, dtype=np.float32), (nb, k, k)).copy()
    for t in range(BLOCK):
        step = (prod.reshape(nb * k, k) @ a).reshape(nb, k, k)
        if t == 0:
            step[heads] = s
        step *= e[:, t, None, :]
        step /= np.maximum(step.max((1, 2)), 1e-30)[:, None, None]
        prod = np.where(real[:, t, None, None], step, prod)

    # vectors at the edges of blocks
    left, right = np.full((nb, k), 1.0 / k, np.float32), np.ones((nb, k), np.float32)
    deep = int(blocks.max())
    active = np.searchsorted(-blocks[order], -np.arange(deep), side="left")  # sequences with more than j blocks
    v = np.full((len(lens), k), 1.0 / k, np.float32)
    for j in range(deep):
        b = first_block[order[: active[j]]] + j
        left[b] = v[: active[j]]
        v = np.einsum("ni,nij->nj", v[: active[j]], prod[b])
        v /= np.maximum(v.sum(1, keepdims=True), 1e-30)
    w = np.ones((len(lens), k), np.float32)
    for j in range(deep - 1, -1, -1):
        b = first_block[order[: active[j]]] + j
        right[b] = w[: active[j]]
        x = np.einsum("nij,nj->ni", prod[b], w[: active[j]])
        w[: active[j]] = x / np.maximum(x.max(1, keepdims=True), 1e-30)

    # inside the blocks
    alpha, before = np.empty((nb, BLOCK, k), np.float32), np.empty((nb, BLOCK, k), np.float32)
    v = left
    for t in range(BLOCK):
        before[:, t] = v
        x = v @ a
        if t == 0:
            x[heads] = s
        x *= e[:, t]
        x /= np.maximum(x.sum(1, keepdims=True), 1e-30)
        v = np.where(real[:, t, None], x, v)
        alpha[:, t] = v
    beta = np.empty((nb, BLOCK, k), np.float32)
    w = right
    for t in range(BLOCK - 1, -1, -1):
        beta[:, t] = w
        x = (e[:, t] * w) @ a.T
        x /= np.maximum(x.max(1, keepdims=True), 1e-30)
        w = np.where(real[:, t, None], x, w)
    gamma = (alpha * beta).reshape(-1, k)[pos]
    gamma /= np.maximum(gamma.sum(1, keepdims=True), 1e-30)
    if not pairs:
        return gamma, None
    follows = real.copy()
    follows[heads, 0] = False
    eb = (e * beta)[follows]
    pre = before[follows]
    norm = np.maximum(np.einsum("ni,ij,nj->n", pre, a, eb), 1e-30)
    return gamma, a * (pre.T.astype(np.float64) @ (eb / norm[:, None]))


def viterbi(emit: np.ndarray, lens: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best label sequence of each sequence; ties go to the smaller label."""
    n, k = emit.shape
    out = np.zeros(n, np.int64)
    if n == 0:
        return out
    has = np.flatnonzero(lens > 0)
    order = has[np.argsort(-lens[has], kind="stable")]
    first = np.zeros(len(lens), np.int64)
    first[1:] = np.cumsum(lens)[:-1]
    deep = int(lens.max())
    active = np.searchsorted(-lens[order], -np.arange(deep), side="left")
    back = np.zeros((n, k), np.int8)
    score = start + emit[first[order]]
    final = np.zeros((len(order), k))
    final[:] = score
    for t in range(1, deep):
        m = active[t]
        x = final[:m, :, None] + trans
        at = first[order[:m]] + t
        back[at] = x.argmax(1)
        final[:m] = x.max(1) + emit[at]
    label = final.argmax(1)
    for t in range(deep - 1, -1, -1):
        m = active[t]
        at = first[order[:m]] + t
        out[at] = label[:m]
        if t:
            label[:m] = back[at, label[:m]]
    return out


def gold_pairs(labels: np.ndarray, lens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of transitions and of first labels in labelled sequences."""
    lens = lens[lens > 0]
    ends = np.cumsum(lens)
    inside = np.ones(len(labels), bool)
    inside[ends - lens] = False
    at = np.flatnonzero(inside)
    trans = np.bincount(labels[at - 1] * k + labels[at], minlength=k * k).reshape(k, k).astype(float)
    return trans, np.bincount(labels[ends - lens], minlength=k).astype(float)


class Adam:
    """The usual moment-scaled gradient step, for a dict of arrays."""

    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict, grads: dict) -> None:
        self.t += 1
        for name, g in grads.items():
            m = self.m[name] = 0.9 * self.m.get(name, 0.0) + 0.1 * g
            v = self.v[name] = 0.999 * self.v.get(name, 0.0) + 0.001 * g * g
            params[name] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
