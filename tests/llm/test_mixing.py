import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing

WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes):
    """Targets by filling up step by step."""
    names = sorted((x for x in sizes if x is not None), key=lambda x: [ord(c) for c in x]) + [None] * (None in sizes)
    weight = {x: (1, 2, 3)[i % 3] for i, x in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [x for x in names if x not in fixed]
        rest = total - sum(fixed.values())
        share = {x: rest * weight[x] / sum(weight[y] for y in free) for x in free}
        over = [x for x in free if share[x] > 3 * sizes[x]]
        if not over:
            return fixed | share
        fixed |= {x: 3.0 * sizes[x] for x in over}


@pytest.mark.parametrize("name", ["odd_documents", "documents", "no_documents"])
def test_plan(request, name):
    docs = request.getfixturevalue(name)
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(WORDS, r.text or ""))
    want = targets(sizes) if sizes else {}
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.plan(docs.repartition(3)).collect()))


@pytest.mark.parametrize("name", ["odd_documents", "documents", "no_documents"])
def test_mixed_takes_what_is_planned(request, name):
    docs = request.getfixturevalue(name)
    count = F.regexp_count("text", F.lit(WORDS))
    got = {r.source: r.n for r in mixing.mixed(docs).groupBy("source").agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).collect()}
    plan = {r.source: r.n for r in mixing.plan(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in plan.items() if v}
    assert mixing.mixed(docs).columns == docs.columns


def test_mixed_keeps_clashing_columns(spark):
    names = ["_d", "_k", "_taken", "_size", "_cut", "_row", "_key", "_place", "_source", "size", "end", "epochs", "m"]
    rows = [(i, " ".join(["w"] * (5 + i % 7)), f"s{i % 3}", *(f"{n}{i}" for n in names)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert got.count() > 0 and all([r[n] for n in names] == [f"{n}{r.doc_id}" for n in names] for r in got.collect())


@pytest.mark.parametrize("ids", ["same", "none"])
def test_repeated_rows_are_taken_by_the_word(spark, ids):
    """The budget ends within a group of equal rows; rows of one id (or none) with different texts are told apart."""
    same = [(7 if ids == "same" else None, "one two three", "a")] * 1001
    other = [(7 if ids == "same" else None, f"t{i} " * 4, "b") for i in range(700)]
    docs = spark.createDataFrame(same + other + [(i, "x y", "c") for i in range(10)], "doc_id long, text string, source string")
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count()
    want = targets({"a": 3003, "b": 2800, "c": 20})
    taken = {s: sum(r.taken for r in rows if r.source == s) for s in want}
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    words = F.sum(F.regexp_count("text", F.lit(WORDS)))
    got = {r.source: r.n for r in mixing.mixed(docs).groupBy("source").agg(words.alias("n")).collect()}
    assert got == taken
