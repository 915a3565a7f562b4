"""Saved indexes that leave out what can't matter: vectors in cells around pivots, postings in blocks with their highest weight.

Both searches are exact. They come in two steps: what is likely to hold the best hits is read first, for a k-th score or
distance to start from; then only that is read which by its bounds could still hold a better hit. Both report what they read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.retrieval import ASKED_BLOCK, DENSE_K, QUERY_BLOCK, SPARSE_K, _best, _codes, _highest, _listed, _met, _nearest_of, _postings, _ranked, joined_terms
from lectern.sources.places import tidied, written

#: Rows a cell or a block of it should hold; pivots at most, which the driver and every task hold; rows that pivots are chosen from.
CELL_ROWS, MOST_PIVOTS, SAMPLE = 20_000, 1024, 4096
#: Documents of a layer of postings; layers at most; queries' tokens that are broadcast.
LAYER_DOCS, MOST_LAYERS, BROADCAST_WORDS = 4096, 256, 400_000
#: Shards of a query that are read first.
FIRST_SHARDS = 2
_FOUND = "query_id long, id long, distance double"


# --- vectors


def pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows that lie far from each other: each one is the farthest from all before it; none twice."""
    chosen, away = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < most and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _to_pivots(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distances from each point to each pivot."""
    return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in at], axis=1)


def save_vectors(vectors: DataFrame, path: str, cell_rows: int = CELL_ROWS) -> None:
    """(id, vector) in a folder for each cell, and of each cell the pivot, the radii and the number of rows.

    A row is in its nearest pivot's cell. Pivots come from a bounded sample, all rows are in a cell. A cell of more than
    ``cell_rows`` rows, as of copies, is cut into blocks. Null vectors are left out; an empty table has no cells.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()
    if not len(some):
        spark.createDataFrame([], "cell int, pivot array<double>, least double, most double, n long, blocks int").write.mode("errorifexists").parquet(f"{path}/cells")
        return
    at = pivots(np.stack(some["vector"].to_numpy()), max(1, min(MOST_PIVOTS, -(-rows.count() // cell_rows))))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = _to_pivots(np.stack(b["vector"].to_numpy()), at)
                yield b.assign(cell=d.argmin(axis=1).astype(np.int32), away=d.min(axis=1))

    placed = written(rows.mapInPandas(place, "id long, vector array<double>, cell int, away double"), "placed")
    cells = placed.groupBy("cell").agg(F.min("away").alias("least"), F.max("away").alias("most"), F.count("*").alias("n"))
    known = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(at)], "cell int, pivot array<double>")
    cells = cells.join(known, "cell").withColumn("blocks", F.ceil(F.col("n") / cell_rows).cast("int"))
    cells = written(cells.select("cell", "pivot", "least", "most", "n", "blocks"), "cells")
    blocks = F.broadcast(cells.select("cell", "blocks"))  # MOST_PIVOTS rows at most
    dealt = placed.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("id", "vector", "cell", "block")
    dealt.repartition("cell", "block").write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/rows")
    cells.coalesce(1).write.mode("errorifexists").parquet(f"{path}/cells")


def saved_search(queries: DataFrame, path: str, k: int = DENSE_K) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, id, distance, rank), as of ``dense_search``, and visits (query_id, read, cells) of a saved collection.

    A query first reads the cells of its nearest pivots that hold k rows together. By the triangle inequality a cell at
    distance d of its pivot holds no row nearer than d - most or least - d; cells for which that exceeds the k-th distance
    found aren't read.
    """
    spark = queries.sparkSession
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("qv")).filter("qv is not null")
    if not len(cells):
        none = asked.limit(0).select("query_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
        return none, asked.select("query_id", F.lit(0).alias("read"), F.lit(0).alias("cells"))
    at, number = np.stack(cells["pivot"].to_numpy()), cells["cell"].to_numpy()
    least, most, count = (cells[x].to_numpy() for x in ("least", "most", "n"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query's cells: without a bound those it reads first, with one the others that it admits."""
        for b in batches:
            out = []
            d = _to_pivots(np.stack(b["qv"].to_numpy()), at) if len(b) else []
            for q, v, bound, away in zip(b["query_id"].tolist(), b["qv"], b["bound"].tolist(), d, strict=True):
                order = np.argsort(away, kind="stable")
                home = order[: int(np.searchsorted(np.cumsum(count[order]), k)) + 1]
                if bound < 0:
                    out += [(q, v, c) for c in number[home].tolist()]
                    continue
                # rounded distances are off by 5e-10 at most, those to pivots by far less than 1e-9 of their length
                gap = np.maximum(np.maximum(away - most, least - away), 0) - 1e-9 * (1 + away)
                admitted = np.maximum(gap, 0) ** 2 <= bound + 1e-9
                admitted[home] = False
                out += [(q, v, c) for c in number[admitted].tolist()]
            yield pd.DataFrame(out, columns=["query_id", "qv", "cell"])

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        return _nearest_of(left, right, k)

    def ask(targets: DataFrame) -> DataFrame:
        """Targets against the rows of their cells; only the folders of these cells are read."""
        wanted = [r.cell for r in targets.select("cell").distinct().collect()]  # MOST_PIVOTS at most
        if not wanted:
            return spark.createDataFrame([], _FOUND)
        load = targets.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("batches"))
        load = F.broadcast(written(load.join(spark.read.parquet(f"{path}/cells").select("cell", "blocks"), "cell"), "load"))
        held = spark.read.parquet(f"{path}/rows").filter(F.col("cell").isin(wanted)).join(load, "cell")
        held = held.select("id", "vector", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch"))
        left = targets.join(load, "cell").withColumn("batch", F.pmod(F.xxhash64("query_id"), F.col("batches")).cast("int"))
        left = left.select("query_id", "qv", F.col("cell").alias("c"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.col("batch").alias("n"))
        return left.groupBy("c", "b", "n").cogroup(held.groupBy("cell", "block", "batch")).applyInPandas(meet, _FOUND)

    columns = "query_id long, qv array<double>, cell int"
    home = written(asked.withColumn("bound", F.lit(-1.0)).mapInPandas(route, columns), "home")
    first = written(ask(home), "first")
    kth = _ranked(first, [F.col("distance"), F.col("id")], k).groupBy("query_id").agg(F.max("distance").alias("d"), F.count("*").alias("m"))
    bound = F.when(F.col("m") >= k, F.col("d")).otherwise(F.lit(float("inf")))
    known = asked.join(kth.select("query_id", bound.alias("bound")), "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    away = written(known.mapInPandas(route, columns), "away")
    hits = _ranked(first.unionByName(ask(away)), [F.col("distance"), F.col("id")], k)
    read = home.unionByName(away).groupBy("query_id").agg(F.count("*").cast("int").alias("read")).withColumn("cells", F.lit(len(cells)))
    return hits, read


# --- postings


def posting_blocks(lists: DataFrame, layer_docs: int = LAYER_DOCS) -> DataFrame:
    """token, shard, least, most, postings of (id, token, weight), arrays as of ``terms``.

    Documents are in layers by their highest weight, so that low layers have low bounds; a layer of more than ``layer_docs``
    documents, as of ties or once there are MOST_LAYERS, is cut into parts by a hash of the id. A part is a shard; one task
    makes its blocks, so that postings are rows nowhere. A block holds a token's postings of a shard, and the least and the
    highest of their weights. Shards are numbered from the highest weights down.
    """
    lists = written(lists.withColumn("top", F.array_max("weight")), "lists")
    docs = lists.count()
    layers = max(1, min(MOST_LAYERS, -(-docs // layer_docs)))
    cuts = sorted(set(lists.approxQuantile("top", [i / layers for i in range(1, layers)], 0.001))) if layers > 1 and docs else []
    layer = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda x: x > F.col("top")))
    rows = lists.select("id", "token", "weight", layer.alias("layer"))
    sizes = {r.layer: r.n for r in rows.groupBy("layer").agg(F.count("*").alias("n")).collect()}  # MOST_LAYERS at most
    parts = [max(1, -(-sizes.get(i, 0) // layer_docs)) for i in range(len(cuts) + 1)]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("layer") + 1)
    shard = of([sum(parts[:i]) for i in range(len(parts))]) + F.pmod(F.xxhash64("id"), of(parts)).cast("int")
    dealt = rows.select("id", "token", "weight", shard.cast("int").alias("shard")).repartitionById(sum(parts), "shard")

    def made(table: pa.Table) -> pa.Table:
        words, weight, ends = _postings(table)
        coded = words.dictionary_encode()
        by_word = np.empty(len(coded.dictionary), np.int64)
        by_word[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(by_word))
        code, row = by_word[coded.indices.to_numpy(zero_copy_only=False)], np.repeat(np.arange(len(table)), np.diff(ends))
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        weight = weight[order]
        pairs = pa.StructArray.from_arrays([table.column("id").combine_chunks().take(pa.array(row[order])), pa.array(weight)], names=["id", "weight"])
        return pa.table({
            "token": words.take(pa.array(order[starts])), "shard": pa.array(np.full(len(starts), table.column("shard")[0].as_py()), pa.int32()),
            "least": np.minimum.reduceat(weight, starts), "most": np.maximum.reduceat(weight, starts),
            "postings": pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), pairs),
        })

    kind = dict(lists.dtypes)["id"]
    return dealt.groupBy("shard").applyInArrow(made, f"token string, shard int, least double, most double, postings array<struct<id: {kind}, weight: double>>")


def save_blocks(index: DataFrame, path: str, layer_docs: int = LAYER_DOCS) -> None:
    """The blocks of (token, id, weight): a file for each shard, sorted by token."""
    with tidied(index.sparkSession):
        posting_blocks(_listed(index, "id"), layer_docs).write.mode("errorifexists").parquet(path)


def save_texts(docs: DataFrame, path: str, layer_docs: int = LAYER_DOCS) -> None:
    """The same of (id, text), without a row for each posting."""
    with tidied(docs.sparkSession):
        posting_blocks(joined_terms(docs, "id"), layer_docs).write.mode("errorifexists").parquet(path)


def postings_of(blocks: DataFrame) -> DataFrame:
    """token, id, weight."""
    return blocks.select("token", F.inline("postings")).select("token", "id", "weight")


def block_search(query_weights: DataFrame, blocks: DataFrame, k: int = SPARSE_K) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, id, sparse_score, rank), as of ``sparse_search``, and reads (query_id, read, blocks) over saved blocks.

    All postings of a document are in one shard. What a document of a shard can score is bounded by the highest weights of
    the query's tokens there; the bounds come from the blocks' heads, without their postings. The shards with the highest
    bounds are read first; then those whose bound reaches the k-th score found. All others are left. A shard's blocks of the
    asked tokens meet its queries in one task, and only the k highest of each leave it.
    """
    asked = written(_listed(query_weights, "query_id"), "asked")
    words = asked.select("query_id", F.explode(F.arrays_zip("token", "weight")).alias("x")).select("query_id", "x.token", F.col("x.weight").alias("qw"))
    few = F.broadcast if words.count() <= BROADCAST_WORDS else lambda x: x
    heads = blocks.select("token", "shard", "least", "most").join(few(words), "token")
    bound = F.sum(F.greatest(F.lit(0.0), F.col("qw") * F.col("least"), F.col("qw") * F.col("most")))
    shards = written(heads.groupBy("query_id", "shard").agg(bound.alias("bound"), F.count("*").alias("n")), "shards")
    last = shards.agg(F.max("shard")).first()[0]
    kinds = dict(asked.dtypes)["query_id"], blocks.schema["postings"].dataType.elementType["id"].dataType.simpleString()

    def cell(a: pa.Table, h: pa.Table) -> pa.Table:
        lists = h.column("postings").combine_chunks()
        ids = lists.flatten().field("id")
        q, doc, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if len(a) and len(ids):
            _, first, docs = np.unique(ids.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
            many = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            codes = lambda known: np.repeat(_codes(h.column("token").combine_chunks(), known), many)
            q, doc, score = _best(a, codes, docs, lists.flatten().field("weight").to_numpy(zero_copy_only=False), len(first), k)
            doc = first[doc]
        return pa.table([a.column("query_id").take(pa.array(q)), ids.take(pa.array(doc)), pa.array(score)], names=["query_id", "id", "sparse_score"])

    def scores(targets: DataFrame) -> DataFrame:
        """Of (query_id, shard, least); queries of a shard in blocks, so that no cell grows with them."""
        load = written(targets.groupBy("shard").agg(F.count("*").alias("m")), "load")
        batches = max(1, -(-(load.agg(F.max("m")).first()[0] or 0) // ASKED_BLOCK))
        left = targets.select("query_id", "least", F.col("shard").alias("p"), F.pmod(F.xxhash64("query_id"), F.lit(batches)).cast("int").alias("b")).join(asked, "query_id")
        held = blocks.join(few(words.select("token").distinct()), "token", "left_semi").join(F.broadcast(load.select("shard")), "shard", "left_semi")
        held = held.select("token", "postings", F.col("shard").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("b"))
        return _met(left, held, batches, (last or 0) + 1).applyInArrow(cell, f"query_id {kinds[0]}, id {kinds[1]}, sparse_score double")

    ahead = _ranked(shards, [F.desc("bound"), F.col("shard")], FIRST_SHARDS).withColumn("least", F.lit(0.0))
    first = written(_highest(scores(ahead), k).drop("rank"), "first")
    kth = first.groupBy("query_id").agg(F.min("sparse_score").alias("s"), F.count("*").alias("m")).filter(F.col("m") >= k).drop("m")
    left = shards.join(ahead.select("query_id", "shard"), ["query_id", "shard"], "left_anti").join(kth, "query_id", "left").withColumn("least", F.coalesce("s", F.lit(0.0)))
    left = written(left.filter((F.col("bound") > 0) & (F.col("s").isNull() | (F.col("bound") >= F.col("s") - 1e-8))), "left")
    hits = _highest(first.unionByName(scores(left)), k)
    used = ahead.select("query_id", "n").unionByName(left.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("read"))
    every = shards.groupBy("query_id").agg(F.sum("n").alias("blocks"))
    return hits, every.join(used, "query_id", "left").select("query_id", F.coalesce("read", F.lit(0)).alias("read"), "blocks")
