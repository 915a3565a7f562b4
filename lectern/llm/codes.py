"""Vectors as short codes: a codebook for each part of the vector, fitted by rounds of exact assignment (Exponion).

Components become integers, floor(scale * x), and everything after that is exact integer arithmetic. A vector is cut into
equal consecutive parts; a part is coded by the index of its nearest entry in its position's codebook.

Assignment (``Book.assign``) starts at an entry a, the one the part had in the round before (in the first round the best of
a few entries, as there's none before). Let u be the distance to a. An entry j that is at least as near as the best one
found so far, at distance b, lies within u + b of a by the triangle inequality, so the entries are scanned in order of their
distance from a, and the scan ends where that distance exceeds u + b, which shrinks as b does. That radius is taken with room
for the rounding of square roots; distances themselves are exact, and of entries equally near the lowest index wins.

Each round writes its codes with the rows to the shared folder, so that the next one starts from them and a lost executor
costs one round; what is superseded is deleted. New entries come from sums by part and entry, added up in each partition
before their shuffle; only these sums, ``parts * entries`` rows whatever the input, reach the driver.

Vectors that are null or hold null or non-finite components are dropped, and so are, as they can't be parted alike or their
squared distances don't fit a long, vectors of another length than the most frequent one (ties: the smaller) and those with
a component whose integer exceeds the root of 2**61 / length. Where the length isn't a multiple of ``parts``, zeros are added at the end. Fewer rows than
entries give a shorter codebook. Null vec_ids come last in the order of vec_ids; of repeated ones the vector that is smaller
component by component comes first. An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Neighbour entries looked at in one step of a scan.
STEP = 16
#: Points that are assigned at once.
ROWS = 1024
#: Every so many entries one is a possible start where no earlier entry is known.
APART = 16


def exact(width: int, top: int) -> type:
    """The fastest kind of number in which squared distances of integers up to ``top`` in magnitude are exact."""
    return np.float64 if 4 * width * top**2 < 2**53 else np.int64


class Book:
    """The entries of one part position, with each entry's neighbours in order of distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.ascontiguousarray(entries, np.int64)
        self.top = int(np.abs(self.entries).max(initial=0))
        every = np.arange(len(self.entries))
        apart = self._distances(self.entries, np.broadcast_to(every, (len(every), len(every))))
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.near = np.sqrt(np.take_along_axis(apart, self.order, axis=1).astype(float))
        self.scanned = 0

    def _distances(self, points: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact squared distances of each point and the entries named in its row of ``which``."""
        top = max(self.top, int(np.abs(points).max(initial=0)))
        kind = exact(points.shape[1], top)
        x, entries = points.astype(kind), self.entries.astype(kind)
        products = np.matmul(entries[which], x[:, :, None])[:, :, 0]
        return ((x**2).sum(axis=1)[:, None] - 2 * products + (entries**2).sum(axis=1)[which]).astype(np.int64)

    def start(self, points: np.ndarray) -> np.ndarray:
        some = np.arange(0, len(self.entries), APART)
        return some[self._distances(points, np.broadcast_to(some, (len(points), len(some)))).argmin(axis=1)]

    def assign(self, points: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each point."""
        found = [self._assign(points[i : i + ROWS], previous[i : i + ROWS].astype(np.int64)) for i in range(0, len(points), ROWS)]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def _assign(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, best = start.copy(), self._distances(x, start[:, None])[:, 0]
        away = np.sqrt(best.astype(float))
        live = np.arange(len(x))
        for at in range(0, len(self.entries), STEP):
            radius = (away[live] + np.sqrt(best[live].astype(float))) * (1 + 1e-9)
            live = live[radius >= self.near[start[live], at]]
            if not len(live):
                break
            which = self.order[start[live], at : at + STEP]
            d = self._distances(x[live], which)
            self.scanned += d.size
            least = d.min(axis=1)
            index = np.where(d == least[:, None], which, len(self.entries)).min(axis=1)
            better = (least < best[live]) | ((least == best[live]) & (index < code[live]))
            best[live[better]], code[live[better]] = least[better], index[better]
        return code, best


def integers(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> tuple[DataFrame, int]:
    """vec_id, label and ``v``, integer components that fill ``parts`` equal parts; and the components of a part (0: no rows).

    The most frequent length is that of vectors whose integers fit, so that where there is one, there are rows.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("x")).filter(F.coalesce(finite, F.lit(False)))
    # as sums of squares over the vector's own length: components beyond this root could overflow it
    fits = F.forall("x", lambda x: F.abs(x) * scale < F.sqrt(F.lit(2.0**61) / F.size("x")) - 2)
    rows = rows.filter((F.size("x") > 0) & fits)
    size = rows.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n").first()
    if size is None:
        return rows.select("vec_id", "label", F.array().cast("array<bigint>").alias("v")), 0
    missing = -size.n % parts
    whole = F.transform("x", lambda x: F.floor(x * scale).cast("long"))
    if missing:
        whole = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), missing))
    return rows.filter(F.size("x") == size.n).select("vec_id", "label", whole.alias("v")), (size.n + missing) // parts


def _coded(rows: DataFrame, books: list[Book], width: int, known: bool) -> DataFrame:
    """``codes`` and ``error`` of each row, started from the row's earlier codes where they're known."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            v = np.stack(b["v"].to_numpy())
            before = np.stack(b["codes"].to_numpy()) if known else None
            codes, error = np.zeros((len(b), len(books)), np.int64), np.zeros(len(b), np.int64)
            for p, book in enumerate(books):
                x = v[:, p * width : (p + 1) * width]
                codes[:, p], d = book.assign(x, before[:, p] if known else book.start(x))
                error += d
            yield b.assign(codes=list(codes.astype(np.int32)), error=error)[["vec_id", "label", "v", "codes", "error"]]

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInPandas(code, f"vec_id long, label {label}, v array<bigint>, codes array<int>, error long")


def _renewed(rows: DataFrame, books: list[Book], width: int) -> list[Book]:
    """Entries as the floored means of their parts; those that no part has stay."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(len(books) - 1)),
        lambda p: F.struct(p.alias("part"), F.element_at("codes", p + 1).alias("entry"), F.slice("v", p * width + 1, width).alias("x")),
    )
    parts = rows.select(F.inline(pieces))
    sums = parts.groupBy("part", "entry").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)))
    new = [x.entries.copy() for x in books]
    for r in sums.collect():
        new[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return [Book(x) for x in new]


def fitted(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[Book]]:
    """The rows with their final codes and errors, written to the shared folder, and the codebooks."""
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.array([r.v for r in first], np.int64).reshape(len(first), parts * width)
    books = [Book(start[:, p * width : (p + 1) * width]) for p in range(parts)]
    at = rows
    for turn in range(rounds + 1):
        coded = stored(_coded(at, books, width, turn > 0), f"codes-{turn}")
        if turn:
            discard(at)
        at = coded
        if turn < rounds:
            books = _renewed(at, books, width)
    return at, books


def hexadecimal(codes: str = "codes"):
    """The codes as text, two hexadecimal digits each (for up to 256 entries)."""
    return F.lower(F.concat_ws("", F.transform(codes, lambda x: F.lpad(F.hex(x), 2, "0"))))


def digest(books: list[Book]) -> str:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.entries.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error (of all rows with that label; null is one) and codebooks_sha256."""
    rows, width = integers(vectors)
    if not width:
        columns = "code string, error long, label_error long, codebooks_sha256 string"
        return rows.sparkSession.createDataFrame([], f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, {columns}")
    coded, books = fitted(rows, width)
    coded = coded.select("vec_id", "label", hexadecimal().alias("code"), "error")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return out.withColumn("codebooks_sha256", F.lit(digest(books)))


def approximate(codes: np.ndarray, books: list[Book], scale: int = SCALE) -> np.ndarray:
    """Vectors that stand for the codes: the entries' components, in the scale of the input."""
    return np.concatenate([b.entries[codes[:, p]] for p, b in enumerate(books)], axis=1) / scale
