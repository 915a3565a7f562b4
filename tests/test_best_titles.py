"""The best other set for each set: against all pairs, and the rows of its joins when the input doubles."""

import random

import pytest

from lectern.operators import corpus as C


def brute(rows):
    out = {}
    for i, x in rows.items():
        best = max(((len(x & y) / len(x | y), -j) for j, y in rows.items() if j != i and x & y), default=None)
        if best:
            out[i] = (best[0], -best[1])
    return out


def found(spark, rows, met=None, most=C.EXPANDED):
    table = spark.createDataFrame([(i, sorted(x), True) for i, x in rows.items()], "id long, tokens array<string>, asks boolean")
    return {r.id: (r.similarity, r.other) for r in C.best_sets(table, most, met).collect()}


@pytest.mark.parametrize("most", [2, 16])
def test_against_all_pairs(spark, most):
    rng = random.Random(most)
    rows = {}
    common = [f"c{i}" for i in range(5)]
    while len(rows) < 150:
        x = set(rng.sample(common, rng.randint(0, 4))) | {f"r{rng.randint(0, 40)}" for _ in range(rng.randint(0, 3))}
        if x and x not in rows.values():
            rows[len(rows) * 7] = x
    rows[5000] = {"alone"}
    assert found(spark, rows, most=most) == brute(rows)


def pairs_of_tokens(n, rng):
    """n sets with one of 64 pairs of frequent tokens each, and rare tokens of their own."""
    rows = {}
    for i in range(n):
        c = rng.randrange(64)
        rows[i] = {f"a{c // 8}", f"b{c % 8}"} | {f"r{rng.randrange(n * 3)}" for _ in range(3)}
    return rows


def near_copies(n, rng):
    """n sets that share ten tokens and have one of their own."""
    return {i: {f"s{j}" for j in range(10)} | {f"own{i}"} for i in range(n)}


@pytest.mark.parametrize("kind", [pairs_of_tokens, near_copies])
def test_rows_in_proportion(spark, kind):
    sums = []
    for n in (1000, 2000):
        rows, met = kind(n, random.Random(1)), []
        got = found(spark, rows, met)
        sums.append(sum(met))
        if n == 1000:
            assert got == brute(rows)
    assert sums[1] <= 2.6 * sums[0] and sums[1] <= 2000 * 60
