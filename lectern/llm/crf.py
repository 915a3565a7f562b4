"""Linear-chain conditional random fields with two labels over hashed or binned features, in NumPy.

Sequences are concatenated; all recursions run over many sequences at once, one position a step, longest first. With two
labels each message is one number, the log-odds of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    """weights: log-odds of label 1 for each feature (the last one, for absent features, is 0); moves[i, j]: i to j."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    first: float


def _order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the sequences that aren't empty, longest first; how many are longer than each position."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    longest = int(lengths.max()) if len(lengths) else 0
    active = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
    return starts[order], lengths[order], active


def emissions(model: Model, features: np.ndarray) -> np.ndarray:
    out = np.full(len(features), model.bias)
    for column in features.T:
        out += model.weights[column]
    return out


def _forward(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray, first: float) -> np.ndarray:
    starts, _, active = _order(lengths)
    out = e.copy()
    for t, n in enumerate(active.tolist()):
        at = starts[:n] + t
        if t:
            before = out[at - 1]
            out[at] += np.logaddexp(moves[0, 1], moves[1, 1] + before) - np.logaddexp(moves[0, 0], moves[1, 0] + before)
        else:
            out[at] += first
    return out


def _backward(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    starts, _, active = _order(lengths)
    out = np.zeros_like(e)
    # before the last position of a sequence: from the longest inwards
    for t in range(len(active) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        after = e[at + 1] + out[at + 1]
        out[at] = np.logaddexp(moves[1, 0], moves[1, 1] + after) - np.logaddexp(moves[0, 0], moves[0, 1] + after)
    return out


def marginals(e: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """Log-odds of label 1 at each position, by forward-backward."""
    return _forward(e, lengths, model.moves, model.first) + _backward(e, lengths, model.moves)


def viterbi(e: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """The most likely labels; a tie goes to label 1."""
    starts, sizes, active = _order(lengths)
    moves = model.moves
    score = e.copy()
    back = np.zeros((len(e), 2), bool)
    for t, n in enumerate(active.tolist()):
        at = starts[:n] + t
        if not t:
            score[at] += model.first
            continue
        before = score[at - 1]  # best path to label 1 less best path to label 0
        to0, to1 = np.maximum(moves[0, 0], moves[1, 0] + before), np.maximum(moves[0, 1], moves[1, 1] + before)
        back[at, 0] = moves[1, 0] + before >= moves[0, 0]
        back[at, 1] = moves[1, 1] + before >= moves[0, 1]
        score[at] += to1 - to0
    labels = np.zeros(len(e), bool)
    labels[starts + sizes - 1] = score[starts + sizes - 1] >= 0
    for t in range(len(active) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        labels[at] = back[at + 1, labels[at + 1].astype(np.int8)]
    return labels


def fit(features: np.ndarray, lengths: np.ndarray, labels: np.ndarray, size: int, steps: int = 60, rate: float = 0.3, decay: float = 1e-6) -> Model:
    """Gradient ascent (Adam) on the mean conditional log-likelihood of the label sequences.

    ``features`` has a row of feature numbers below ``size`` for each position; ``size - 1`` stands for none.
    """
    model = Model(np.zeros(size, np.float32), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))), np.zeros((2, 2)), 0.0)
    if not len(labels):
        return model
    starts, ends = np.cumsum(lengths) - lengths, np.cumsum(lengths) - 1
    starts, ends = starts[lengths > 0], ends[lengths > 0]
    inner = np.ones(len(labels), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    gold = labels.astype(np.float64)
    told = np.array([[((1 - gold[inner - 1]) * (1 - gold[inner])).sum(), ((1 - gold[inner - 1]) * gold[inner]).sum()], [(gold[inner - 1] * (1 - gold[inner])).sum(), (gold[inner - 1] * gold[inner]).sum()]])
    theta = [model.weights.astype(np.float64), np.array(model.bias), model.moves, np.array(0.0)]
    mean, square = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for step in range(1, steps + 1):
        model = Model(theta[0], float(theta[1]), theta[2], float(theta[3]))
        e = emissions(model, features)
        f, b = _forward(e, lengths, model.moves, model.first), _backward(e, lengths, model.moves)
        p = 1 / (1 + np.exp(-np.clip(f + b, -60, 60)))
        # pairwise marginals of neighbours
        before, after = f[inner - 1], e[inner] + b[inner]
        logs = np.stack([np.full(len(inner), model.moves[0, 0]), model.moves[0, 1] + after, model.moves[1, 0] + before, model.moves[1, 1] + before + after])
        logs = np.exp(logs - logs.max(axis=0))
        pairs = (logs / logs.sum(axis=0)).sum(axis=1).reshape(2, 2)
        error = gold - p
        grad = [sum(np.bincount(column, error, minlength=size) for column in features.T), np.array(error.sum()), told - pairs, np.array(error[starts].sum())]
        grad[0][size - 1] = 0
        for i, g in enumerate(grad):
            g = g / len(labels) - decay * theta[i]
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            theta[i] = theta[i] + rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    return Model(theta[0].astype(np.float32), float(theta[1]), theta[2], float(theta[3]))
