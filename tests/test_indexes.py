"""Saved indexes: equal to the plain searches, and what they don't read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import indexes as I
from lectern.operators import retrieval as R


def hits(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("cell_rows", [40, 10**6])
def test_vectors_equal_the_plain_search(spark, tmp_path, cell_rows):
    rng = np.random.default_rng(cell_rows)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(500)] + [(1000 + i, [1.0] * 6) for i in range(300)] + [(9999, None)]
    table = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = table.filter("id % 25 = 0 and vector is not null").select(F.col("id").alias("query_id"), "vector")
    I.save_vectors(table, f"{tmp_path}/v", cell_rows)
    found, read = I.saved_search(asked, f"{tmp_path}/v", 10)
    assert hits(found) == hits(R.dense_search(asked, table.filter("vector is not null"), 10))
    assert all(1 <= r.read <= r.cells for r in read.collect()) and read.count() == asked.count()


def test_clusters_leave_most_cells_out(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    points = centres[rng.integers(0, 40, 4000)] + 0.02 * rng.normal(size=(4000, 16))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "id long, vector array<double>")
    asked = table.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    I.save_vectors(table, f"{tmp_path}/v", 100)
    found, read = I.saved_search(asked, f"{tmp_path}/v", 10)
    assert hits(found) == hits(R.dense_search(asked, table, 10))
    rows = read.collect()
    assert sum(r.read for r in rows) < 0.2 * sum(r.cells for r in rows)


def test_no_vectors_and_few_vectors(spark, tmp_path):
    table = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.5, 1.0])], "id long, vector array<double>")
    asked = table.select(F.col("id").alias("query_id"), "vector")
    I.save_vectors(table.limit(0), f"{tmp_path}/none")
    found, read = I.saved_search(asked, f"{tmp_path}/none")
    assert found.collect() == [] and [r.read for r in read.collect()] == [0, 0]
    I.save_vectors(table, f"{tmp_path}/few")
    assert hits(I.saved_search(asked, f"{tmp_path}/few")[0]) == hits(R.dense_search(asked, table))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        I.save_vectors(table, f"{tmp_path}/few")


def texts(n, rng, words=60):
    names = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(words)]
    return [(i, " ".join(rng.choices(names, k=rng.choice([2, 5, 30, 200])) + ["the"] * rng.randint(0, 3))) for i in range(n)]


@pytest.mark.parametrize("layer_docs", [10, 100_000])
def test_postings_equal_the_plain_search(spark, tmp_path, layer_docs, monkeypatch):
    monkeypatch.setattr(I, "MOST_LAYERS", 12)  # layers are cut into parts
    rng = random.Random(layer_docs)
    docs = spark.createDataFrame(texts(400, rng), "id long, text string")
    index = R.sparse_index(docs)
    asked = R.weights(docs.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "text"), "query_id")
    I.save_blocks(index, f"{tmp_path}/p", layer_docs)
    blocks = spark.read.parquet(f"{tmp_path}/p")
    found, read = I.block_search(asked, blocks, 10)
    assert hits(found) == hits(R.sparse_search(asked, index, 10))
    assert all(0 < r.read <= r.blocks for r in read.collect())
    assert hits(I.postings_of(blocks)) == hits(index)


def test_negative_weights_and_foreign_tokens(spark, tmp_path):
    index = spark.createDataFrame([("a", 1, 0.5), ("a", 2, -0.5), ("b", 2, 0.25), ("b", 3, -1.0)], "token string, id long, weight double")
    asked = spark.createDataFrame([(1, "a", -1.0), (1, "b", 1.0), (2, "zz", 1.0)], "query_id long, token string, weight double")
    I.save_blocks(index, f"{tmp_path}/p", 1)
    found, _ = I.block_search(asked, spark.read.parquet(f"{tmp_path}/p"), 5)
    assert hits(found) == hits(R.sparse_search(asked, index, 5))


def test_low_layers_are_left(spark, tmp_path):
    """Long documents have low weights: where short ones hold the query's tokens, their blocks aren't read."""
    rng = random.Random(7)
    docs = [(i, "ozone " + " ".join(rng.choices("klmnopqrst", k=1)) * 3) for i in range(60)]
    docs += [(100 + i, "ozone " + " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(100 + i))) for i in range(600)]
    index = R.sparse_index(spark.createDataFrame(docs, "id long, text string"))
    asked = R.weights(spark.createDataFrame([(1, "ozone")], "query_id long, text string"), "query_id")
    I.save_blocks(index, f"{tmp_path}/p", 40)
    found, read = I.block_search(asked, spark.read.parquet(f"{tmp_path}/p"), 25)
    assert hits(found) == hits(R.sparse_search(asked, index, 25))
    r = read.first()
    assert r.read <= 0.4 * r.blocks


def test_texts_are_indexed_without_posting_rows(spark, tmp_path, monkeypatch):
    """Straight from texts the same blocks come, in shards of bounded size whatever ties their weights have, and no posting is shuffled as a row."""
    rng = random.Random(5)
    docs = spark.createDataFrame([*texts(150, rng), *((500 + i, "ozone flux") for i in range(100)), (700, ""), (701, None)], "id long, text string")
    I.save_texts(docs, f"{tmp_path}/t", 20)
    blocks = spark.read.parquet(f"{tmp_path}/t")
    assert hits(I.postings_of(blocks)) == hits(R.sparse_index(docs))
    per_shard = [r.n for r in blocks.select("shard", F.explode("postings.id").alias("id")).groupBy("shard").agg(F.countDistinct("id").alias("n")).collect()]
    assert sum(per_shard) == 250 and max(per_shard) <= 40  # 100 equal texts are several shards
    asked = R.weights(docs.filter("id % 10 = 0").select(F.col("id").alias("query_id"), "text"), "query_id")
    monkeypatch.setattr(I, "ASKED_BLOCK", 5)
    found = I.block_search(asked, blocks, 4)[0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroupsInArrow" in plan and "inline" not in plan
    assert hits(found) == hits(R.sparse_search(asked, R.sparse_index(docs), 4))
