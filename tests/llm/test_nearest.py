import numpy as np
import pytest

from lectern.llm import nearest

NAN, INF = float("nan"), float("inf")


def brute(rows, is_query, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, all_ = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if is_query(i):
            d = np.sqrt(((all_ - v) ** 2).sum(axis=1))
            out[i] = sorted((x, j) for x, j in zip(d.tolist(), ids.tolist()) if j != i)[:k]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize(("sf", "cell"), [("0.01", 20_000), ("0.1", 20_000), ("0.1", 100)])
def test_recall(spark, sf, cell):
    table = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    real, got = brute(rows, lambda i: i % 20 == 0), found(nearest.nearest(table, "vec_id % 20 = 0", cell=cell, block=70 if cell == 100 else 20_000).collect())
    assert real.keys() == got.keys()
    assert np.mean([len({i for _, i in real[q]} & {i for _, i in got[q]}) / len(real[q]) for q in real]) >= 0.95
    for q, best in got.items():
        score = dict((i, s) for s, i in best)
        assert best == sorted(best) and all(abs(score[i] - s) < 1e-12 for s, i in real[q] if i in score)


def test_odd_vectors(spark):
    rows = [(None, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [0.0, 0.0]), (2, None), (3, [NAN, 1.0]), (4, [INF, 1.0]), (5, [None, 1.0]), (6, [3.0, 1.0]), (7, [1.0, 2.0]), (200, [9.0, 9.0]), (8, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as cell", "2 as bound", "3 as v")
    got = found(nearest.nearest(table, block=2).collect())
    assert got == {q: v for q, v in brute([r for r in rows if r[0] != 8], lambda i: i % 100 == 0).items()}
    assert nearest.nearest(table.limit(0)).collect() == []


def test_many_copies(spark):
    table = spark.createDataFrame([(i, [1.0, 1.0, float(i % 7 == 3) * i]) for i in range(3000)], "vec_id long, embedding array<float>")
    got = found(nearest.nearest(table, cell=50, block=100).collect())
    assert [i for _, i in got[0]] == [1, 2, 4, 5, 6, 7, 8, 9, 11, 12]


@pytest.mark.parametrize("dimension", [16, 64, 384])
def test_many_copies_in_one_block(dimension):
    """More copies of the query than a step holds, their projections apart by rounding."""
    rng = np.random.default_rng(dimension)
    ids, vectors = rng.permutation(20_000), rng.normal(size=(20_000, dimension)).astype(np.float32).astype(float)
    vectors[:3000] = vectors[0]
    to = nearest.directions(dimension)
    query, own = vectors[0], int(ids[0])
    right = sorted(i for i in ids[:3000].tolist() if i != own)[:10]
    for some in (np.arange(20_000), nearest.distinct_enough(ids, vectors, 10)):
        tree = nearest.Tree(ids[some], vectors[some], to)
        assert tree.nearest(query, own, 10, nearest.chi_square(nearest.PROBABILITY, nearest.PROJECTED)) == [(0.0, i) for i in right]


def test_copies_across_cells(spark):
    """Copies of float vectors in blocks of more than a step, also where a cut goes through them."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(4, 32))
    ids = rng.permutation(4000).tolist()
    table = spark.createDataFrame([(i, base[n % 4].tolist()) for n, i in enumerate(ids)], "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    for cell in (20_000, 100):
        assert found(nearest.nearest(table, cell=cell).collect()) == brute(rows, lambda i: i % 100 == 0)


def test_repeated_ids_among_copies(spark):
    rows = [(0, [1.0, 2.0])] * 30 + [(1, [1.0, 2.0])] * 30 + [(2, [-0.0, 2.0]), (100, [0.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(nearest.nearest(table).collect())
    assert got[0] == [(0.0, 1)] * 10 and got[100][0] == (0.0, 2) and len(got[100]) == 10


def test_chi_square():
    assert abs(nearest.chi_square(0.99, 8) - 20.0902) < 1e-3 and abs(nearest.chi_square(0.5, 1) - 0.4549) < 1e-3


def share(ids, vectors, queries):
    """Mean share of rows verified, and recall at 10, for one block."""
    limit = nearest.chi_square(nearest.PROBABILITY, nearest.PROJECTED)
    tree, right = nearest.Tree(ids, vectors, nearest.directions(vectors.shape[1])), 0
    for q in queries:
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        right += len(set(ids[np.argsort(d, kind="stable")[:10]].tolist()) & {i for _, i in tree.nearest(vectors[q], int(ids[q]), 10, limit)})
    return tree.verified / len(queries) / len(ids), right / len(queries) / 10


def test_share_verified_on_clusters():
    """What is verified of 50,000 and of 12,500 clustered vectors is a few clusters, not a share of the rows."""
    rng = np.random.default_rng(5)
    counts = []
    for n in (12_500, 50_000):
        centres = rng.normal(size=(n // 100, 64))
        vectors = centres[rng.integers(0, len(centres), n)] + 0.15 * rng.normal(size=(n, 64))
        part, recall = share(np.arange(n), vectors, rng.choice(n, 40, replace=False))
        assert part <= 0.08 and recall >= 0.9
        counts.append(part * n)
    assert counts[1] <= 2 * counts[0]


def test_share_verified_on_an_even_sphere(spark):
    """No projection tells neighbours well apart here; the search still leaves a third out."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    part, recall = share(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), range(0, 2000, 20))
    assert part <= 0.75 and recall >= 0.95


def test_a_repeated_query_asks_once(spark):
    rows = [(0, [3.0, 1.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0])]
    for some in (rows, rows[::-1]):
        got = found(nearest.nearest(spark.createDataFrame(some, "vec_id long, embedding array<float>")).collect())
        assert got[0] == [(0.0, 1), (5**0.5, 2)]
