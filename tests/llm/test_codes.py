import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from lectern.llm import codes, queries

NAN, INF = float("nan"), float("inf")


def plain(rows, parts=4, entries=256, rounds=4):
    """The same in whole numbers of Python, every entry held against every part; rows are (vec_id, embedding, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    ordered = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in ordered[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p])) for p, x in enumerate(cut(v))] for _, v, _ in kept]

    for _ in range(rounds):
        members = defaultdict(list)
        for found, (_, v, _) in zip(assign(), kept, strict=True):
            for p, x in enumerate(cut(v)):
                members[p, found[p][1]].append(x)
        for (p, j), xs in members.items():
            books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    last = assign()
    errors = [sum(d for d, _ in f) for f in last]
    by_label = defaultdict(int)
    for e, (_, _, label) in zip(errors, kept, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{j:02x}" for _, j in f), e, by_label[label], sha) for (i, _, label), f, e in zip(kept, last, errors, strict=True)]


def held(spark, rows, tmp_path):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as v", "'x' as codes", "2 as error", "3 as `of`")
    table.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    back = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    return sorted(map(repr, map(tuple, got.collect()))), back


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], rng.choice([0, 1, None])) for i in range(400)]
    rows += [(1000 + i, rows[i % 5][1], 2) for i in range(300)]  # many copies
    rows += [(2000 + i, [float(rng.randint(-1, 1)) for _ in range(8)], 3) for i in range(60)]  # ties
    rows += [(None, rows[0][1], 1), (3, rows[7][1], 1), (5000, None, 1), (5001, [NAN] * 8, 1), (5002, [None] * 8, 1), (5003, [INF] * 8, 1), (5004, [0.0] * 8, None)]
    rng.shuffle(rows)
    got, back = held(spark, rows, tmp_path)
    assert got == sorted(map(repr, plain(back)))


def test_fewer_rows_than_entries(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(4)], None) for i in range(7)]
    got, back = held(spark, rows, tmp_path)
    assert got == sorted(map(repr, plain(back)))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, [1.5, 2.0, 3.0], 0), (3, [1.0], 0), (4, [], 0), (5, [1e30, 0.0, 0.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in codes.compressed(table).collect()}
    assert got.keys() == {1, 2} and got[1].code == "00000000" and got[2].code == "01000000"
    for none in (table.limit(0), table.filter("vec_id > 3")):
        assert codes.compressed(none).collect() == [] and codes.compressed(none).columns == codes.compressed(table).columns


@pytest.mark.parametrize("top", [3, 900, 40_000_000])
def test_assignment_from_any_start(top):
    """Small numbers make ties, large ones leave the doubles."""
    rng = np.random.default_rng(top)
    book = codes.Book(rng.integers(-top, top + 1, (256, 16)))
    points = rng.integers(-top, top + 1, (3000, 16))
    d = np.stack([((points - e) ** 2).sum(axis=1) for e in book.entries], axis=1)
    for start in (rng.integers(0, 256, 3000), book.start(points), np.zeros(3000, np.int64)):
        index, found = book.assign(points, start)
        assert (index == d.argmin(axis=1)).all() and (found == d.min(axis=1)).all()


def test_few_entries_are_scanned_near_their_entry():
    """Where parts lie close to their earlier entry, the radius leaves most entries out."""
    rng = np.random.default_rng(2)
    entries = rng.integers(-5000, 5000, (256, 16))
    before = rng.integers(0, 256, 5000)
    book = codes.Book(entries)
    index, _ = book.assign(entries[before] + rng.integers(-300, 300, (5000, 16)), before)
    assert (index == before).all() and book.scanned <= 5000 * codes.STEP


def test_codes_stand_for_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows, width = codes.integers(table)
    coded, books = codes.fitted(rows, width)
    found = coded.collect()
    near = codes.approximate(np.array([r.codes for r in found]), books)
    real = np.array([r.v for r in found]) / codes.SCALE
    assert np.allclose(((near - real) ** 2).sum(axis=1) * codes.SCALE**2, [r.error for r in found])
    assert ((near - real) ** 2).sum() < 0.5 * ((real - real.mean(axis=0)) ** 2).sum()
