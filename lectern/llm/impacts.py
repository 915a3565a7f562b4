"""Exact top-k by inner product over an impact-ordered index, read score at a time.

Components become integers, floor(scale * x). Rows are dealt into blocks of about BLOCK rows by a hash of vec_id. The index
of a block (``Postings``) has for every dimension LEVELS posting segments: the places of the rows whose component falls into
one of LEVELS equal steps between the block's least and greatest, with the exact least and greatest component of each segment.

A query's weight for a dimension turns each segment into a quantised impact: the most that it can add above the least that
any row gets from that dimension. The segments of all dimensions are read in descending order of impact, and a row's
accumulator gets the segment's least impact. What a row can still reach is its accumulator, the steps' widths of the
dimensions read for it and, for every other dimension, the impact of that dimension's next segment. Rows whose reach is
below the k-th accumulator, or below the k-th score known from another block, are given up; reading stops when the rows left
are few enough to be rescored (a FEW-th of the block) or no segment is left, both of which prove that no row given up is among
the k best. The rows left are rescored exactly and ranked by score, then vec_id.

Queries meet the block they lie in first, which gives each of them a k-th score to start from in all other blocks; a block
whose best imaginable row is below it is left at once. The index is written to the shared folder, one row for each block.

Vectors that are null or hold null or non-finite components take no part, nor do null vec_ids, vectors of another length
than the most frequent one (ties: the smaller), or components whose integers exceed the root of 2**61 / length, as scores might not fit a long. Zero vectors do. A
repeated vec_id asks once, with the vector that is smaller component by component, and none of its rows is found for it.
An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

SCALE = 256
BEST = 5
BLOCK = 8192
LEVELS = 32
#: Reading stops where at most one in FEW rows of a block is left.
FEW = 32
#: Segments read between two looks at what rows can still reach.
TURN = 256
#: Queries that meet a block at once.
BATCH = 500


#: The arrays of a block as they're written.
_KINDS = {"ids": "<i8", "vectors": "<i8", "level": "<i1", "places": "<i4", "ends": "<i8", "low": "<i8", "high": "<i8"}


class Postings:
    """The segments of one block: rows by dimension and level, with exact bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, level: np.ndarray, places: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.vectors, self.places, self.ends, self.low, self.high = ids, vectors, places, ends, low, high
        self.starts = np.concatenate([np.zeros((len(ends), 1), np.int64), ends[:, :-1]], axis=1)
        self.filled = ends > self.starts
        self.segment = level.astype(np.int32) + np.arange(len(ends), dtype=np.int32) * ends.shape[1]
        self.read = self.rescored = 0

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS) -> Postings:
        n, d = vectors.shape
        least, most = vectors.min(axis=0), vectors.max(axis=0)
        level = ((vectors - least) // ((most - least) // levels + 1)).astype(np.int8)
        places = np.argsort(level, axis=0, kind="stable").T.astype(np.int32)
        ends = np.cumsum(np.stack([np.bincount(level[:, i], minlength=levels) for i in range(d)]), axis=1)
        low, high = np.zeros((d, levels), np.int64), np.zeros((d, levels), np.int64)
        for i in range(d):
            values, start = vectors[places[i], i], 0
            for at, end in enumerate(ends[i].tolist()):
                if end > start:
                    low[i, at], high[i, at] = values[start:end].min(), values[start:end].max()
                start = end
        return cls(ids, vectors, level, places, ends, low, high)

    def row(self) -> dict[str, bytes]:
        d, levels = self.ends.shape
        level = (self.segment - np.arange(d, dtype=np.int32) * levels).astype(np.int8)
        arrays = {"ids": self.ids, "vectors": self.vectors, "level": level, "places": self.places, "ends": self.ends, "low": self.low, "high": self.high}
        return {name: np.ascontiguousarray(x, _KINDS[name]).tobytes() for name, x in arrays.items()}

    @classmethod
    def from_row(cls, row: dict[str, bytes], d: int) -> Postings:
        flat = {name: np.frombuffer(row[name], kind) for name, kind in _KINDS.items()}
        shapes = {"ids": (-1,), "vectors": (-1, d), "level": (-1, d)}
        flat["places"] = flat["places"].astype(np.int64)
        return cls(**{name: x.reshape(shapes.get(name, (d, -1))) for name, x in flat.items()})

    def best(self, query: np.ndarray, own: int, k: int, known: int | None = None, few: int = FEW) -> list[tuple[int, int]]:
        """The k best as (score, id), ids equal to ``own`` left out; rows below ``known`` may be missing."""
        n = len(self.ids)
        w = query.astype(np.int64)
        ends = np.stack([self.low * w[:, None], self.high * w[:, None]])
        least, most = ends.min(axis=0), ends.max(axis=0)
        floor = np.where(self.filled, least, np.iinfo(np.int64).max).min(axis=1)
        impact = np.where(self.filled, most - floor[:, None], -1)
        gain = least - floor[:, None]
        base = int(floor.sum())
        bound = None if known is None else known - base  # of accumulators, from here on
        if bound is not None and int(impact.max(axis=1).sum()) < bound:
            return []
        width = np.where(self.filled, most - least, 0).max(axis=1)
        order = np.argsort(-impact, axis=None, kind="stable")
        order = order[impact.ravel()[order] > 0]
        # sums of gains and of products are whole numbers that a double holds
        exact = int(np.abs(ends).max(initial=0)) * len(w) < 2**52
        total = np.zeros(n, np.int64)
        live = np.flatnonzero(self.ids != own)
        starts, stops = self.starts.ravel(), self.ends.ravel()
        flat, done = self.places.ravel(), np.zeros(impact.size, bool)
        base_of = np.repeat(np.arange(len(impact)) * n, impact.shape[1])
        for at in range(0, len(order), TURN):
            if len(live) <= max(n // few, k):
                break
            turn = order[at : at + TURN]
            done[turn] = True
            places = [flat[base_of[i] + starts[i] : base_of[i] + stops[i]] for i in turn.tolist()]
            gains, sizes = gain.ravel()[turn], stops[turn] - starts[turn]
            if exact:
                total += np.bincount(np.concatenate(places), np.repeat(gains, sizes).astype(float), n).astype(np.int64)
            else:
                for rows, add in zip(places, gains.tolist(), strict=True):
                    total[rows] += add
            self.read += int(sizes.sum())
            read = done.reshape(impact.shape)
            rest = np.where(read, 0, np.maximum(impact, 0)).max(axis=1)
            some = total[live]
            kth = int(np.partition(some, len(live) - k)[len(live) - k]) if len(live) >= k else None
            if kth is not None and (bound is None or kth > bound):
                bound = kth
            if bound is None:
                continue
            # what is still open: a step's width where the dimension was read, else its next segment; first for any row at
            # most, then, where that leaves out half of the rows or no segment follows, for each row
            live = live[some + int(np.where(read.any(axis=1), np.maximum(width, rest), rest).sum()) >= bound]
            if len(live) <= n // 2 or at + TURN >= len(order):
                open_ = np.where(read, width[:, None], rest[:, None]).ravel()
                live = live[total[live] + np.take(open_, self.segment[live]).sum(axis=1) >= bound]
        self.rescored += len(live)
        # products of whole numbers are exact as doubles up to 2**53, and faster
        scores = (self.vectors[live].astype(float) @ w.astype(float)).astype(np.int64) if exact else self.vectors[live] @ w
        first = np.lexsort((self.ids[live], -scores))[:k]
        return list(zip(scores[first].tolist(), self.ids[live[first]].tolist(), strict=True))


def _usable(vectors: DataFrame, scale: int) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("x") > 0))
    # sums of products, and differences of such sums, stay within a long
    rows = rows.filter(F.forall("x", lambda x: F.abs(x) * scale < F.sqrt(F.lit(2.0**61) / F.size("x")) - 2))
    size = rows.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n").first()
    if size is None:
        return rows.select("vec_id", F.array().cast("array<bigint>").alias("v"))
    return rows.filter(F.size("x") == size.n).select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


_INDEX = "block int, d int, " + ", ".join(f"{name} binary" for name in _KINDS)
_FOUND = "query_id long, vec_id long, score long"


def indexed(rows: DataFrame, blocks: int) -> DataFrame:
    """The postings of each block of the rows (vec_id, v), as one row, written to the shared folder."""

    def put(block: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(block["v"].to_numpy()).astype(np.int64)
        row = Postings.of(block["vec_id"].to_numpy(np.int64), v).row()
        return pd.DataFrame([{"block": int(block["block"].iloc[0]), "d": v.shape[1], **row}])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    return stored(dealt.groupBy("block").applyInPandas(put, _INDEX), "impacts")


def top(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = BEST, block: int = BLOCK, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest inner products for each query row."""
    rows = stored(_usable(vectors, scale), "integers")
    count = rows.count()
    blocks = max(1, -(-count // block))
    index = indexed(rows, blocks)
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    home = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    queries = stored(queries.select(F.col("vec_id").alias("q"), F.col("v").alias("qv"), home.alias("home")), "queries")
    batches = max(1, -(-queries.count() // BATCH))

    def visit(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(asked) and len(held):
            row = held.iloc[0]
            postings = Postings.from_row(row, int(row["d"]))
            for own, v, known in zip(asked["q"].tolist(), asked["qv"], asked["known"].tolist(), strict=True):
                out += [(own, i, s) for s, i in postings.best(np.asarray(v), own, k, known[0] if len(known) else None)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def ask(targets: DataFrame) -> DataFrame:
        """Queries (q, qv, known) against the blocks they name, BATCH of them at a time."""
        held = index.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
        asked = targets.withColumn("qn", F.pmod(F.xxhash64("q"), F.lit(batches)).cast("int"))
        return asked.groupBy("qb", "qn").cogroup(held.groupBy("block", "n")).applyInPandas(visit, _FOUND)

    def best(found: DataFrame) -> DataFrame:
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")))
        return found.groupBy("query_id").agg(F.slice(ranked, 1, k).alias("best"))

    unknown = F.array().cast("array<bigint>")
    at_home = stored(ask(queries.select("q", "qv", F.col("home").alias("qb"), unknown.alias("known"))), "home")
    kth = best(at_home).select(F.col("query_id").alias("q"), F.when(F.size("best") == k, F.array(-F.element_at("best", -1)["s"])).alias("known"))
    away = queries.join(kth, "q", "left").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).filter("qb <> home")
    found = at_home.unionByName(ask(away.select("q", "qv", "qb", F.coalesce("known", unknown).alias("known"))))
    ranked = best(found).select("query_id", F.posexplode("best").alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))
