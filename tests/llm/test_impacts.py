import math
import random

import numpy as np
import pytest

from lectern.llm import impacts

NAN, INF = float("nan"), float("inf")


def brute(rows, is_query, k=5, scale=256):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if is_query(i):
            asked[i] = min(asked.get(i, v), v)
    return {i: sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i))[:k] for i, v in asked.items()}


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("block", [8192, 90])
def test_against_brute_force(spark, block):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert found(impacts.top(table, "vec_id % 5 = 0", block=block).collect()) == brute(rows, lambda i: i % 5 == 0)


def test_odd_vectors(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5]) for _ in range(3)]) for i in range(300)]  # ties
    rows += [(i, [0.25, 0.5, -1.0]) for i in range(300, 900)]  # one vector many times
    rows += [(50, [0.5, 0.5, 0.5]), (7, rows[8][1]), (7, rows[8][1]), (900, [0.0] * 3), (None, [1.0] * 3), (950, None), (951, [NAN] * 3), (952, [None] * 3), (953, [INF] * 3)]
    rng.shuffle(rows)
    extra = [(1000, [1.0]), (1050, []), (1100, [1e30, 0.0, 0.0])]  # another length; scores beyond a long
    table = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "'x' as block", "2 as q", "3 as known")
    for block in (8192, 100):
        assert found(impacts.top(table, block=block).collect()) == brute(rows, lambda i: i % 50 == 0)
    assert impacts.top(table.limit(0)).collect() == []
    assert found(impacts.top(table.filter("vec_id = 900")).collect()) == {}


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_reading_stops_on_proof(spread):
    """The k best of a block from postings, with and without a known score; on clusters most rows aren't rescored."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    v = np.floor(256 * (centres[rng.integers(0, 40, 6000)] + spread * rng.normal(size=(6000, 32)))).astype(np.int64)
    ids = rng.permutation(6000)
    postings = impacts.Postings.of(ids, v)
    again = impacts.Postings.from_row(postings.row(), 32)
    for at in range(0, 6000, 150):
        scores = v @ v[at]
        right = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != ids[at])[:5]
        right = [(-s, i) for s, i in right]
        assert again.best(v[at], int(ids[at]), 5) == right == postings.best(v[at], int(ids[at]), 5, known=right[-1][0])
        assert again.best(v[at], int(ids[at]), 5, known=int(scores.max()) ** 2) == []
    assert again.rescored <= 40 * 6000 // 20 and again.read < 40 * 6000 * 32
    if spread < 1:  # hardly more than the query's own cluster
        assert again.rescored <= 40 * 6000 // 30


def test_known_scores_cut_ties_right():
    ids, v = np.arange(100), np.ones((100, 4), np.int64)
    postings = impacts.Postings.of(ids, v)
    assert postings.best(v[0], 0, 5, known=4) == [(4, i) for i in range(1, 6)] and postings.best(v[0], 0, 5, known=5) == []
