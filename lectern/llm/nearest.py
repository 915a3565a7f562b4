"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees, stopped by a chi-square test.

Vectors are projected by PROJECTED Gaussian (2-stable) directions: of a pair at distance d the squared projected distance
is d**2 times a chi-square variable of PROJECTED degrees. A kd-tree over projections, fitted on a bounded sample, cuts the
space into cells of about CELL rows, and every row is indexed in its cell, in a block of BLOCK rows at most in the mean:
crowded cells (copies of one vector can't be told apart) have several blocks.

1. Each query meets the blocks of its own cell and keeps its k nearest: an upper bound for its k-th distance.
2. It then visits only cells whose box is within sqrt(q) times that bound of its projection, q being the PROBABILITY
   quantile of the chi-square distribution.

Within a block (``Tree``) the search is incremental: a kd-tree over the block's projections is walked best node first, so
that rows come in order of projected distance, and each is verified by its original distance in double precision. It ends
when the test holds that no unseen row is among the k nearest with PROBABILITY: the next projected distance, of a row or a
node, exceeds sqrt(q) times the k-th distance found. Nodes that weren't reached by then are never opened. Both tests leave
room for the rounding of projections, as copies of a query are at distance 0 but their projections only nearly so.

How much is verified depends on the data: on clustered vectors a small share; on vectors that are spread evenly over a
sphere of 64 dimensions, where the tenth neighbour is three quarters as far as the median row, two fifths of 50,000 rows.

In a block, equal vectors come down to as many rows as can be among the k nearest of any query (``distinct_enough``).
Queries travel to cells in batches of rows, never all to one place; what returns is k rows for each query and block.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; with fewer candidates than k all are returned; ties go to the smaller vec_id; a repeated vec_id is one candidate for
each of its rows, asks once, with the least of its vectors, and no row with the query's own vec_id is its candidate; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

PROJECTED = 16
PROBABILITY = 0.92
NEIGHBOURS = 10
SAMPLE = 20_000
CELL = 20_000
BLOCK = 20_000
#: Rows of a leaf of a block's tree.
LEAF = 512
#: Queries that meet a block at once.
BATCH = 5000
SEED = 20_250


def chi_square(probability: float, degrees: int) -> float:
    """The quantile of the chi-square distribution, by bisection of its series."""

    def below(x: float) -> float:
        term = total = 1 / (degrees / 2)
        i = 1
        while term > 1e-16 * total:
            term *= x / 2 / (degrees / 2 + i)
            total += term
            i += 1
        return total * math.exp(degrees / 2 * math.log(x / 2) - x / 2 - math.lgamma(degrees / 2))

    low, high = 1e-9, 10.0 * degrees + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < probability else (low, middle)
    return high


def directions(dimension: int, projected: int = PROJECTED) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dimension, projected))


class Cells:
    """A kd-tree whose leaves are cells: boxes of the projected space."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.axis: list[int] = []
        self.cut: list[float] = []
        self.down: list[tuple[int, int]] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        everywhere = np.full(points.shape[1], np.inf)
        self.root = self._grow(points, leaves, -everywhere, everywhere)

    def _leaf(self, low: np.ndarray, high: np.ndarray) -> int:
        self.low.append(low)
        self.high.append(high)
        return -len(self.low)

    def _grow(self, points: np.ndarray, leaves: int, low: np.ndarray, high: np.ndarray) -> int:
        axis = int(np.argmax(points.max(axis=0) - points.min(axis=0))) if len(points) else 0
        if leaves <= 1 or len(points) < 2 or points[:, axis].min() == points[:, axis].max():
            return self._leaf(low, high)
        cut = float(np.median(points[:, axis]))
        left = points[:, axis] < cut
        if not left.any():  # half of the points or more share the least value
            cut = float(points[points[:, axis] > cut, axis].min())
            left = points[:, axis] < cut
        at = len(self.axis)
        self.axis.append(axis)
        self.cut.append(cut)
        self.down.append((0, 0))
        upper, lower = high.copy(), low.copy()
        upper[axis] = lower[axis] = cut
        self.down[at] = (self._grow(points[left], leaves // 2, low, upper), self._grow(points[~left], leaves - leaves // 2, lower, high))
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)

        def go(node: int, rows: np.ndarray) -> None:
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                left = points[rows, self.axis[node]] < self.cut[node]
                go(self.down[node][0], rows[left])
                go(self.down[node][1], rows[~left])

        go(self.root, np.arange(len(points)))
        return out

    def within(self, point: np.ndarray, radius: float) -> np.ndarray:
        """Cells that hold a place within ``radius`` of ``point``; the radius includes the room for rounding."""
        low, high = np.stack(self.low), np.stack(self.high)
        gap = np.maximum(np.maximum(low - point, point - high), 0)
        return np.flatnonzero((gap**2).sum(axis=1) <= radius**2)


def reach(query: np.ndarray, to: np.ndarray, limit: float, bound: float) -> float:
    """The projected distance up to which a vector within ``bound`` is looked for, with room for the rounding of both projections.

    A sum of n products is off by at most n * eps * |v| * |direction|, and a vector within ``bound`` is no longer than |query| + bound.
    """
    return limit**0.5 * bound + 4 * len(query) * np.finfo(float).eps * np.linalg.norm(to) * (2 * np.linalg.norm(query) + bound)


def distinct_enough(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among the k nearest of a query: of equal vectors k rows at most of each of the k + 1 least ids.

    All of them are equally far from any query, whose own id may be one of these.
    """
    kept, seen = [], {}
    plain = np.ascontiguousarray(vectors) + 0.0  # -0.0 equals 0.0
    for at in np.argsort(ids, kind="stable").tolist():
        of = seen.setdefault(plain[at].tobytes(), {})
        i = int(ids[at])
        if i in of or len(of) <= k:
            of[i] = of.get(i, 0) + 1
            if of[i] <= k:
                kept.append(at)
    return np.array(kept, np.int64)


class Tree:
    """A kd-tree over the projections of a block, walked from the node nearest to a query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, to: np.ndarray, leaf: int = LEAF):
        self.to = to
        self.places = vectors @ to
        self.rows: list[np.ndarray | None] = []
        self.down: list[tuple[int, int]] = []
        low, high = [], []
        self.verified = 0

        def grow(rows: np.ndarray) -> int:
            at, points = len(self.rows), self.places[rows]
            low.append(points.min(axis=0))
            high.append(points.max(axis=0))
            self.rows.append(rows)
            self.down.append((0, 0))
            axis = int(np.argmax(high[at] - low[at]))
            if len(rows) > leaf and high[at][axis] > low[at][axis]:
                half = len(rows) // 2
                order = np.argpartition(points[:, axis], half)
                self.rows[at] = None
                self.down[at] = (grow(rows[order[:half]]), grow(rows[order[half:]]))
            return at

        if len(ids):
            grow(np.arange(len(ids)))
            self.low, self.high = np.stack(low), np.stack(high)
        self.ids, self.vectors = ids, vectors

    def nearest(self, query: np.ndarray, own: int, k: int, limit: float, known: float = np.inf) -> list[tuple[float, int]]:
        """The k nearest found, whose ids aren't ``own``; ``known`` is a bound of the k-th distance."""
        if not len(self.ids):
            return []
        point = query @ self.to
        best: list[tuple[float, int]] = []
        bound = known
        nodes = [(0.0, 0)]
        waiting, distances = np.zeros(0, np.int64), np.zeros(0)
        while nodes or len(waiting):
            if nodes and (not len(waiting) or nodes[0][0] <= distances.min()):
                # a node comes first: it's opened, and its rows wait for their turn
                near, at = heapq.heappop(nodes)
                if near > reach(query, self.to, limit, bound) ** 2:
                    break
                if self.rows[at] is None:
                    below = list(self.down[at])
                    gap = np.maximum(np.maximum(self.low[below] - point, point - self.high[below]), 0)
                    for child, d in zip(below, (gap**2).sum(axis=1).tolist(), strict=True):
                        heapq.heappush(nodes, (d, child))
                    continue
                rows = self.rows[at]
                rows = rows[self.ids[rows] != own]
                waiting = np.concatenate([waiting, rows])
                distances = np.concatenate([distances, ((self.places[rows] - point) ** 2).sum(axis=1)])
                continue
            # all rows that are nearer than any node left, nearest first, as many at once as could end the search
            ready = distances <= nodes[0][0] if nodes else np.ones(len(waiting), bool)
            order = np.flatnonzero(ready)[np.argsort(distances[ready], kind="stable")]
            if distances[order[0]] > reach(query, self.to, limit, bound) ** 2:
                break
            order = order[: max(LEAF, len(waiting) // 8)]
            rows = waiting[order]
            kept = np.ones(len(waiting), bool)
            kept[order] = False
            waiting, distances = waiting[kept], distances[kept]
            d = np.sqrt(((self.vectors[rows] - query) ** 2).sum(axis=1))
            self.verified += len(rows)
            some = np.flatnonzero(d <= bound)
            best = sorted([*best, *zip(d[some].tolist(), self.ids[rows[some]].tolist(), strict=True)])[:k]
            if len(best) == k:
                bound = min(bound, best[-1][0])
        return best


def _usable(rows: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


_FOUND = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = NEIGHBOURS, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query row."""
    rows = _usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n").first()
    if sizes is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, count = sizes.n, sizes.m
    rows = rows.filter(F.size("v") == dimension)
    to, limit = directions(dimension), chi_square(PROBABILITY, PROJECTED)
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE).select("v").toPandas()
    cells = Cells(np.stack(sample["v"].to_numpy()) @ to, max(1, count // cell))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(cell=cells.of(np.stack(b["v"].to_numpy()) @ to) if len(b) else np.zeros(0, np.int64))

    placed = stored(rows.mapInPandas(place, "vec_id long, v array<double>, cell long"), "placed")
    full = placed.groupBy("cell").agg(F.count("*").alias("m")).select("cell", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    indexed = placed.join(full, "cell").select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"))

    def visit(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        ids, there = held["vec_id"].to_numpy(), np.stack(held["v"].to_numpy())
        some = distinct_enough(ids, there, k)
        ids, there = ids[some], there[some]
        tree, out = Tree(ids, there, to), []
        for own, v, known in zip(asked["q"].tolist(), asked["qv"], asked["bound"].tolist(), strict=True):
            out += [(own, i, d) for d, i in tree.nearest(np.asarray(v), own, k, limit, known)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    def ask(targets: DataFrame) -> DataFrame:
        """Each query against all blocks of its target cells, BATCH queries at a time."""
        spread = targets.join(full, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        spread = stored(spread.select(F.col("vec_id").alias("q"), F.col("v").alias("qv"), "bound", F.col("cell").alias("qc"), F.col("block").alias("qb")), "asked")
        load = spread.groupBy("qc", "qb").agg(F.ceil(F.count("*") / BATCH).cast("int").alias("batches"))
        asked = spread.join(load, ["qc", "qb"]).withColumn("qn", F.pmod(F.xxhash64("q"), F.col("batches")).cast("int"))
        held = indexed.join(load, (F.col("cell") == F.col("qc")) & (F.col("block") == F.col("qb"))).drop("qc", "qb")
        held = held.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))
        asked, held = asked.select("q", "qv", "bound", "qc", "qb", "qn"), held.select("vec_id", "v", "cell", "block", "n")
        return asked.groupBy("qc", "qb", "qn").cogroup(held.groupBy("cell", "block", "n")).applyInPandas(visit, _FOUND)

    def best(found: DataFrame) -> DataFrame:
        ranked = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k)
        return found.groupBy("query_id").agg(ranked.alias("best"))

    queries = placed.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("one")).select("vec_id", "one.*")
    home = stored(ask(queries.withColumn("bound", F.lit(float("inf")))), "home")
    known = best(home).select(F.col("query_id").alias("vec_id"), F.when(F.size("best") == k, F.element_at("best", -1)["score"]).alias("bound"))
    known = queries.join(known, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, v, own, bound in zip(b["vec_id"].tolist(), b["v"], b["cell"].tolist(), b["bound"].tolist(), strict=True):
                out += [(i, v, c, bound) for c in cells.within(np.asarray(v) @ to, reach(np.asarray(v), to, limit, bound)).tolist() if c != own]
            yield pd.DataFrame(out, columns=["vec_id", "v", "cell", "bound"])

    away = ask(known.select("vec_id", "v", "cell", "bound").mapInPandas(route, "vec_id long, v array<double>, cell long, bound double"))
    ranked = best(home.unionByName(away)).select("query_id", F.posexplode("best").alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
