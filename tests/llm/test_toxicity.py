import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import queries, toxicity


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


@pytest.mark.parametrize(("sf", "recall"), [("0.01", 0.65), ("0.1", 0.85)])
def test_held_out_accuracy(spark, sf, recall):
    d = f"/root/testdata/sf{sf}"
    rows = queries.op10_toxicity(spark, d)
    marks = spark.read.parquet(f"{d}/labels.parquet")
    for r in rows.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1
    n = rows.join(marks, "doc_id").filter("held_out").agg(
        F.sum((F.col("toxic") == 1).cast("int")).alias("bad"),
        F.sum(((F.col("toxic") == 1) & (F.col("predicted") == 1)).cast("int")).alias("hit"),
        F.sum(((F.col("toxic") == 0) & (F.col("predicted") == 1)).cast("int")).alias("false"),
        F.sum((F.col("toxic") == 0).cast("int")).alias("clean"),
    ).first()
    print(n)
    assert n.hit >= recall * n.bad and n.false <= 0.02 * n.clean
    assert rows.count() == spark.read.parquet(f"{d}/documents.parquet").count()


def test_odd_rows(odd_documents, no_documents, labels):
    scorer = toxicity.train(odd_documents, labels)
    rows = toxicity.scores(odd_documents, scorer).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scores(no_documents, toxicity.train(no_documents, labels.limit(0))).collect() == []


def test_offsets(spark):
    scorer = toxicity.fit([f"éİ w{i} good words here {'rotten' if i % 2 else 'nice'} x{i * 7}".encode() for i in range(200)], np.arange(200) % 2 == 1, 0.5)
    docs = spark.createDataFrame([(1, "éİ😀 A Rotten apple"), (2, "a nice apple"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in toxicity.scores(docs, scorer).collect()}
    assert found == {1: [(6, 12)], 2: [], 3: []}


def brute_score(scorer, text):
    """The score of one text by enumerating all labellings of its tokens, and its offending tokens."""
    low = "".join(y if len(y := x.lower()) == 1 else x for x in text)
    tokens = toxicity.Tokens([low.encode()])
    field, found = scorer.field, [m.span() for m in re.finditer(r"[a-z0-9\u0080-\U0010ffff]+", low)]
    assert len(found) == len(tokens.features)
    e = [field.bias + sum(float(field.weights[x]) for x in row) for row in tokens.features]
    weight, on = 0.0, [0.0] * len(e)
    for y in itertools.product([0, 1], repeat=len(e)):
        w = math.exp(sum(a * b for a, b in zip(y, e)) + (field.first * y[0] if y else 0) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
        weight += w
        on = [a + w * b for a, b in zip(on, y)]
    p = [x / weight for x in on]
    highest = max((min(12, max(-12, math.log(x / (1 - x)))) for x in p), default=-12)
    curve = scorer.curve
    z = curve[0] + curve[1] * highest / 4 + curve[2] * math.log(1e-4 + sum(p)) / 4
    return 1 / (1 + math.exp(-max(-30, min(30, z)))), [s for s, x in zip(found, p) if x >= 0.5]


def test_scores_equal_enumeration(spark):
    rng = np.random.default_rng(2)
    words = ["good", "nice", "rotten", "Rottenly", "été", "b4d", "words", "İx"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(200)]
    scorer = toxicity.fit([t.encode() for t in texts], np.array(["otten" in t for t in texts]), 0.3)
    docs = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in enumerate(texts[:60])], "doc_id long, text string, spans string, score double")
    for r in toxicity.scores(docs, scorer).collect():
        score, spans = brute_score(scorer, texts[r.doc_id])
        assert abs(r.score - score) < 1e-6 and [(s.start, s.end) for s in r.spans] == spans


def test_nothing_offends_without_labels(spark, documents):
    rows = toxicity.scores(documents.limit(5), toxicity.fit([], np.zeros(0, bool), 0.0)).collect()
    assert all(r.score == 0 and r.spans == [] for r in rows)
