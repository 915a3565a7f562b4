import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_boilerplate import brute as brute_lines
from test_minhash import brute as brute_near
from test_quality import brute as brute_quality

from lectern.llm.shared import keyed, stored

SF = "/root/testdata/sf0.001"
WORDS = r"[^\x20\x09-\x0D]+"


def heads(rows):
    """Of each group of near duplicates the row with the smallest doc_id, by comparing all; wordless rows are in none.

    ``rows`` differ, and of rows with one id in one group either may stay.
    """
    rows = sorted(rows, key=repr)
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    group = {i: c for i, _, c in brute_near(numbered, 5)}
    least = {}
    for i, c in group.items():
        if (rows[i][1] or "").strip(" \t\n\x0b\x0c\r"):
            least[c] = min(least.get(c, i), i, key=lambda x: rows[x][0])
        else:
            least[c, i] = i
    return [rows[i] for i in least.values()]


@pytest.mark.parametrize("name", ["odd_documents", "documents", "no_documents"])
def test_stages(spark, request, name):
    docs = request.getfixturevalue(name)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near dedup", "mix sources", "pack"]

    good = stored(stages["quality rules"](spark, docs, SF), "q")
    assert good.columns == columns
    left, before = Counter(map(repr, good.collect())), Counter(map(repr, docs.collect()))
    assert not left - before
    assert not any(brute_quality(r.text)[-1] for r in good.collect())

    lines = stored(stages["line dedup"](spark, good, SF), "l")
    assert lines.columns == columns
    rows = [(r._d, r._k, r.text, r.source) for r in keyed(good, "source").collect()]
    expected = [(d, t) for d, t, _, gone in brute_lines(rows, 10) if not gone or re.search(WORDS, t)]
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == sorted(expected)

    near = stored(stages["near dedup"](spark, lines, SF), "n")
    assert near.columns == columns
    rows = {(r.doc_id, r.text) for r in lines.collect()}
    assert sorted(heads(rows), key=repr) == sorted(((r.doc_id, r.text) for r in near.collect()), key=repr)
    own = {(r.doc_id, r.text): [r[x] for x in columns] for r in lines.collect()}
    assert all([r[x] for x in columns] == own[r.doc_id, r.text] for r in near.collect())

    mixed = stored(stages["mix sources"](spark, near, SF), "m")
    assert mixed.columns == columns
    size = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(WORDS)))).first()[0] or 0
    sources = near.select("source").distinct().count()
    assert abs(size(mixed) - size(near)) <= sources

    packed = stored(stages["pack"](spark, mixed, SF), "p")
    assert Counter(r.doc_id for r in packed.filter("piece = 0").collect()) == Counter(r.doc_id for r in mixed.collect())


def test_near_dedup_with_null_and_repeated_ids(spark):
    """Unrelated texts that share an id, or have none, stay; near copies go whatever their ids; wordless rows stay."""
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (8, text("f")), (8, text("f") + " more"), (9, text("d") + " more")]
    rows += [(None, text("g")), (None, text("g")), (5, text("a")), (3, None), (3, ""), (3, " "), (3, " "), (None, None)]
    got = dict(corpus_pipeline.STAGES)["near dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    got = Counter((r.doc_id, r.text) for r in got)
    of_f = [x for x in got if x[0] == 8]
    assert len(of_f) == 1 and got.pop(of_f[0]) == 1
    assert got == Counter([(None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (None, text("g")), *rows[11:]])


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    used = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("m"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert used.filter("n > 1024 or n <> end").count() == 0 and rows.count() > 0
