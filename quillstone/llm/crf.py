"""Linear-chain conditional random fields over many sequences at once.

Sequences lie end to end in flat arrays. Messages are computed by an associative scan over transition matrices, so
a sequence of n items takes log2(n) vectorised steps and no step loops over items.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _compose(a: np.ndarray, b: np.ndarray, best: bool) -> np.ndarray:
    """Product of two stacks of matrices in the log semiring, or with maximum for sum."""
    terms = a[:, :, :, None] + b[:, None, :, :]
    top = terms.max(axis=2)
    if best:
        return top
    return top + np.log(np.exp(terms - top[:, :, None, :]).sum(axis=2))


def _scan(mats: np.ndarray, begin: np.ndarray, best: bool) -> np.ndarray:
    """Inclusive products within sequences; begin: each item's number within its sequence."""
    step, longest = 1, int(begin.max(initial=0)) + 1
    mats = mats.copy()
    while step < longest:
        at = np.flatnonzero(begin >= step)
        mats[at] = _compose(mats[at - step], mats[at], best)
        step *= 2
    return mats


def _numbers(lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


@dataclass
class Crf:
    """scores = features @ weights; moves[i, j]: score of label j after label i. mean, scale: of the features as trained."""

    weights: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return np.hstack([np.clip(x, -8, 8), np.ones((len(x), 1))]) @ self.weights

    def marginals(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(label | sequence) of each item."""
        a, b, _ = messages(self.scores(features), self.moves, lengths)
        m = a + b
        m = np.exp(m - m.max(axis=1, keepdims=True))
        return m / m.sum(axis=1, keepdims=True)

    def viterbi(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The labels of each sequence's best path: at every item the label with the best path through it; ties: the lower label."""
        a, b, _ = messages(self.scores(features), self.moves, lengths, best=True)
        return np.round(a + b, 9).argmax(axis=1)


def messages(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray, best: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages of each item, and each sequence's log partition (or best score). Empty sequences: 0."""
    n, k = scores.shape
    lengths = np.asarray(lengths, dtype=np.int64)
    number = _numbers(lengths)
    mats = moves[None] + scores[:, None, :]
    mats[number == 0] = scores[number == 0][:, None, :]
    forward = _scan(mats, number, best)[:, 0, :]
    left = np.repeat(lengths, lengths) - 1 - number
    follow = np.full((n, k, k), -1e30)
    follow[:, range(k), range(k)] = 0.0
    inner = np.flatnonzero(left > 0)
    follow[inner] = mats[inner + 1]
    back = _scan(np.ascontiguousarray(follow[::-1].transpose(0, 2, 1)), left[::-1], best)[::-1].transpose(0, 2, 1)
    top = back.max(axis=2)
    backward = top if best else top + np.log(np.exp(back - top[:, :, None]).sum(axis=2))
    z = np.zeros(len(lengths))
    some = lengths > 0
    last = forward[np.cumsum(lengths)[some] - 1]
    peak = last.max(axis=1)
    z[some] = peak if best else peak + np.log(np.exp(last - peak[:, None]).sum(axis=1))
    return forward, backward, z


def train(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, classes: int = 2, rounds: int = 80, penalty: float = 1e-3, rate: float = 0.15) -> Crf:
    """Maximises the penalised conditional likelihood by Adam, over all sequences in every round."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = np.hstack([np.clip((features - mean) / scale, -8, 8), np.ones((len(features), 1))])
    n, lengths = len(x), np.asarray(lengths, dtype=np.int64)
    number = _numbers(lengths)
    inner = np.flatnonzero(number > 0)
    want = np.zeros((n, classes))
    want[np.arange(n), labels] = 1
    seen = np.zeros((classes, classes))
    np.add.at(seen, (labels[inner - 1], labels[inner]), 1)
    params = [np.zeros((x.shape[1], classes)), np.zeros((classes, classes))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        scores = x @ params[0]
        a, b, z = messages(scores, params[1], lengths)
        zs = np.repeat(z, lengths)
        node = np.exp(a + b - zs[:, None])
        pair = np.exp(a[inner - 1][:, :, None] + params[1][None] + (scores[inner] + b[inner])[:, None, :] - zs[inner][:, None, None]).sum(axis=0) if len(inner) else np.zeros((classes, classes))
        slopes = [x.T @ (want - node) / n - penalty * params[0], (seen - pair) / n - penalty * params[1]]
        for p, g, u, v in zip(params, slopes, first, second):
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            p += rate * (u / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Crf(params[0], params[1], mean, scale)
