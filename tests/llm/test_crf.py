import itertools

import numpy as np
import pytest

from lectern.llm import crf


@pytest.mark.parametrize("seed", range(6))
def test_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 7, 9)
    e = rng.normal(size=lengths.sum()) * 2
    model = crf.Model(np.zeros(1, np.float32), 0.0, rng.normal(size=(2, 2)), float(rng.normal()))
    odds, best = crf.marginals(e, lengths, model), crf.viterbi(e, lengths, model)
    at = 0
    for n in lengths.tolist():
        part = e[at : at + n]
        paths = list(itertools.product([0, 1], repeat=n))
        score = np.array([sum(p * x for p, x in zip(y, part)) + (model.first * y[0] if n else 0) + sum(model.moves[a, b] for a, b in zip(y, y[1:])) for y in paths])
        if n:
            weight = np.exp(score)
            p1 = np.array([[y[i] for i in range(n)] for y in paths]).T @ weight / weight.sum()
            assert np.allclose(odds[at : at + n], np.log(p1 / (1 - p1)))
            assert paths[int(score.argmax())] == tuple(best[at : at + n].astype(int))
        at += n


def test_fit_learns_features_and_moves():
    rng = np.random.default_rng(1)
    lengths = rng.integers(5, 30, 200)
    labels = np.concatenate([np.repeat(rng.integers(0, 2, n // 5 + 1), 5)[:n] for n in lengths])
    shown = np.where(rng.random(len(labels)) < 0.8, labels, 1 - labels)
    model = crf.fit(np.stack([shown, np.full(len(shown), 3)], axis=1), lengths, labels, 4)
    found = crf.viterbi(crf.emissions(model, np.stack([shown, np.full(len(shown), 3)], axis=1)), lengths, model)
    assert (found == labels).mean() > 0.83 > (shown == labels).mean()
