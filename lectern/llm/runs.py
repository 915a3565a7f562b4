"""Periodic runs of words, by power-of-two naming (Karp, Miller and Rosenberg).

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that holds at least
``EXPONENT`` periods and ``SHORTEST`` words and that no neighbouring word extends keeping period q.

Names: level 0 numbers the words of a text; level k + 1 numbers the pairs of level-k names 2**k apart. Equal names mean
equal stretches, with no hash in between, and numbers come from sorting pairs of integers, never suffixes. The longest
common extension of two places is read off by descending levels: where the names are equal, both places move on.

Candidates lie on a grid: a run of period q and at least 4 * q words holds a multiple i of 3 * q and i + q, so for each q
only these places are compared, first their words, then their extensions to both sides. Over all q that's a third of
n * ln(n) places for n words. A stretch that has a period smaller than q comes out at that period too, with the same ends
(it's at least as long as both periods together), so of equal ends the smallest period stays.

The texts of about two million bytes share their arrays: names of different texts differ, so that nothing is found across
a border. Memory is in proportion to the longest text's words times the levels that still repeat.

A null text has no words; empty texts neither; very long texts are handled whole, by one task each; repeated rows give
their rows again; an empty table gives no rows; columns other than doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

EXPONENT = 4
SHORTEST = 6
#: Places compared at once.
CANDIDATES = 1 << 20


def renamed(values: np.ndarray) -> tuple[np.ndarray, bool]:
    """Numbers from 0 for the distinct values, in their order, and whether any value repeats."""
    distinct, names = np.unique(values, return_inverse=True)
    return names.astype(np.int32), len(distinct) < len(values)


class Names:
    """Names of all stretches of 2**k words, k = 0, 1, ..., as long as any stretch occurs twice.

    Beyond the last level nothing repeats, so a common extension takes at most one step of each level.
    """

    def __init__(self, words: np.ndarray):
        names, again = renamed(words)
        self.levels = [names]
        while again:
            below, step = self.levels[-1].astype(np.int64), 1 << (len(self.levels) - 1)
            if len(below) <= step:
                break
            names, again = renamed(below[:-step] * (len(below) + 1) + below[step:])
            if again:
                self.levels.append(names)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on; i < j."""
        i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, step = self.levels[k], 1 << k
            inside = np.flatnonzero(j < len(names))
            same = inside[names[i[inside]] == names[j[inside]]]
            i[same] += step
            j[same] += step
            length[same] += step
        return length

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j; i < j."""
        i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, step = self.levels[k], 1 << k
            inside = np.flatnonzero(i >= step)
            same = inside[names[i[inside] - step] == names[j[inside] - step]]
            i[same] -= step
            j[same] -= step
            length[same] += step
        return length


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods q to compare in a text of n words: multiples i of 3 * q with i + q inside."""
    last = n // EXPONENT
    if n < SHORTEST or not last:
        return
    periods = np.arange(1, last + 1, dtype=np.int64)
    counts = -(-(n - periods) // (3 * periods))
    ends = np.cumsum(counts)
    at = 0
    while at < last:
        before = int(ends[at - 1]) if at else 0
        to = max(int(np.searchsorted(ends, before + CANDIDATES, side="right")), at + 1)
        q = np.repeat(periods[at:to], counts[at:to])
        turn = np.arange(len(q), dtype=np.int64) - np.repeat(ends[at:to] - counts[at:to] - before, counts[at:to])
        yield 3 * q * turn, q
        at = to


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, given as numbers of its words; in order of start, then period."""
    sizes = np.array([len(x) for x in texts], np.int64)
    firsts = np.cumsum(sizes) - sizes
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return found
    words = np.concatenate(texts).astype(np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    words += owner * (int(words.max()) + 1)  # a word of another text is another word
    names = Names(words)
    word, starts, lengths, periods = names.levels[0], [], [], []

    def look(i: np.ndarray, q: np.ndarray) -> None:
        before, after = names.behind(i, i + q), names.ahead(i, i + q)
        length = before + after + q
        good = length >= np.maximum(SHORTEST, EXPONENT * q)
        starts.append((i - before)[good])
        lengths.append(length[good])
        periods.append(q[good])

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for first, n in zip(firsts.tolist(), sizes.tolist(), strict=True):
        for i, q in grid(n):
            i = i + first
            same = word[i] == word[i + q]
            waiting.append((i[same], q[same]))
            count += len(waiting[-1][0])
            if count >= CANDIDATES:
                look(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                waiting, count = [], 0
    if waiting:
        look(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
    if not starts:
        return found
    s, n, q = (np.concatenate(x) for x in (starts, lengths, periods))
    order = np.lexsort((q, n, s))
    s, n, q = s[order], n[order], q[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (n[1:] != n[:-1])
    s, n, q = s[new], n[new], q[new]
    order = np.lexsort((q, s))
    for start, length, period in zip(s[order].tolist(), n[order].tolist(), q[order].tolist(), strict=True):
        of = int(owner[start])
        found[of].append((start - int(firsts[of]), length, period))
    return found


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


_OUT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, ``runs`` (start, length and period in words, by start, then period) and the ``collapsed`` text.

    In the collapsed text every run is cut down to its first period; its words are joined by one space.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, part in slices(batches):
            words = [x.split() for x in texts]  # bytes are split at 0x20 and 0x09 to 0x0D
            runs = runs_of([numbered(x) for x in words])
            flat = [x for of in runs for x in of]
            columns = [pa.array([x[k] for x in flat], pa.int64()) for k in range(3)]
            places = np.cumsum([0, *(len(x) for x in runs)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(places), pa.StructArray.from_arrays(columns, fields=list(run)))
            kept = [collapsed(w, r) for w, r in zip(words, runs, strict=True)]
            counts = pa.array([len(x) for x in words], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), counts, lists, pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, _OUT)


def strongest(runs: str = "runs"):
    """The run with the greatest exact length / period (ties: smallest start, then period), null without runs."""
    first = F.element_at(F.col(runs), 1)

    def better(best, x):
        return F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best)

    return F.when(F.size(runs) > 0, F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), first, better))
