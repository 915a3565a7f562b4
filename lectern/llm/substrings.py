"""Substring dedup by relative Lempel-Ziv parsing against an index of every text of the corpus.

The reference is the whole corpus, indexed in blocks: a block holds the stretches of text that share an anchor. Of the
LENGTH - GRAM + 1 word GRAM-tuples inside a window of LENGTH words the leftmost with the least hash is the window's anchor,
so equal windows have equal anchors at equal places; each text falls into consecutive stretches of windows with one
anchor (about one for 12 words). The anchor leads a stretch to the only block that can hold any of its windows, so each
text is parsed against every block that could matter, and none is lost.

1. Index: only anchors that occur twice or more can lie in a repeated window; all others end here, after one aggregation
   that is combined before its shuffle. In a block each distinct stretch stands once, with its first and last place.
2. Matches: a stretch that occurs twice or more matches as a whole, with another place of its words as its source. Copies of
   a passage end here, however many there are.
3. Boundaries: where the stretches of a block differ, their windows are compared one by one.
4. Greedy factors: a text's matches are taken from left to right, and a factor grows for as long as the next match goes on
   in the same source at the next place. Factors have LENGTH words at least, and where two meet, or overlap, windows across
   their border have matches of their own. The words that factors cover are duplicate.

Each window is thereby judged on the input, with 128 bits (a hash of the anchor and one of the words). Of several sources
the first in the corpus is taken (the last, by a text that is the first itself), so a factor can be shorter than the
longest match anywhere in the corpus; the words covered are the same.

Defined cases: null texts have no words; texts shorter than a window lose nothing; repeated rows are copies of each other;
ties of places go to the smaller doc_id, then text hash; a very long text is hashed in pieces and parsed whole; a text that
repeats a passage inside loses all its occurrences; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed, matched, stored
from .words import BLANK, first_minimum, mix, runs, texts, windows, word_hashes

LENGTH = 35
GRAM = 12
_ANCHOR_BASE = 0xA24BAED4963EE407
_WINDOW_BASE = 0x9FB21C651E98DF25


def stretches(w: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """lo, hi (first and last window), anchor hash and content hash of each stretch of a text of words ``w``."""
    grams = windows(w, gram, _ANCHOR_BASE)
    place = first_minimum(grams, length - gram + 1)
    if not len(place):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    cut = np.flatnonzero(np.diff(place)) + 1
    lo = np.concatenate([[0], cut])
    hi = np.concatenate([cut, [len(place)]]) - 1
    whole = windows(w, length, _WINDOW_BASE)
    at = place[lo]
    content = mix(whole[lo] + mix(whole[hi] + mix(((hi - lo) << 20 | (at - lo)).astype(np.uint64))))
    return lo, hi, grams[at].view(np.int64), content.view(np.int64)


def _anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, d, k in texts(batches, "_d", "_k"):
            out = []
            for x, dd, kk in zip(text, d, k, strict=True):
                lo, hi, anchor, content = stretches(word_hashes(x), length, gram)
                if len(lo):
                    n = len(lo)
                    out.append((np.full(n, dd), np.full(n, kk), lo << 20 | (hi - lo), anchor, content))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["_d", "_k", "at", "a", "c"])

    return rows.mapInArrow(parse, "_d long, _k long, at long, a long, c long")


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """The windows of the stretches in ``spots``: one row each, with the hash of its words."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, d, k, spots in texts(batches, "_d", "_k", "spots"):
            out = []
            for x, dd, kk, here in zip(text, d, k, spots, strict=True):
                whole = windows(word_hashes(x), length, _WINDOW_BASE).view(np.int64)
                at = np.array([s["at"] for s in here], np.int64)
                lo, many = at >> 20, (at & (1 << 20) - 1) + 1
                first = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
                anchor = np.repeat(np.array([s["a"] for s in here], np.int64), many)
                out.append((np.full(len(first), dd), np.full(len(first), kk), first, anchor, whole[first]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["_d", "_k", "at", "a", "h"])

    return rows.mapInArrow(hashes, "_d long, _k long, at long, a long, h long")


def matches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """_d, _k, spans: array of (at, sd, sk, to), runs of windows of a text that occur elsewhere too, each with one such place.

    ``at`` is the first window, shifted by 20 bits, and how many follow it; ``to`` the first window in the source (sd, sk).
    One row for each text that has any; rows of ``docs`` that are equal in id and text share it.
    """
    place = F.struct("_d", "_k", "at")
    anchors = stored(_anchors(keyed(docs), length, gram), "anchors")
    twice = stored(anchors.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "twice")
    found = stored(anchors.join(twice, "a"), "candidates")
    blocks = found.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(place).alias("x"), F.max(place).alias("y"))
    blocks = stored(blocks, "blocks")
    several = blocks.groupBy("a").agg(F.count("*").alias("blocks")).filter("blocks > 1").select("a")
    whole = found.join(blocks.filter("n > 1").select("a", "c", "x", "y"), ["a", "c"])
    edge = blocks.join(several, "a").select("x._d", "x._k", "x.at", "a")
    spots = stored(edge.groupBy("_d", "_k").agg(F.collect_list(F.struct("at", "a")).alias("spots")), "spots")
    rows = stored(_windows(matched(keyed(docs), spots), length), "windows")
    # rows of docs that are equal would count a window twice: places are compared
    again = rows.groupBy("a", "h").agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x <> y")
    single = rows.join(again, ["a", "h"])
    source = F.when(F.col("x") == place, F.col("y")).otherwise(F.col("x"))
    whole = whole.select("_d", "_k", "at", source.alias("s")).select("_d", "_k", F.struct("at", F.col("s._d").alias("sd"), F.col("s._k").alias("sk"), F.shiftright("s.at", 20).alias("to")).alias("m"))
    single = single.select("_d", "_k", "at", source.alias("s")).select(
        "_d", "_k", F.struct(F.shiftleft("at", 20).alias("at"), F.col("s._d").alias("sd"), F.col("s._k").alias("sk"), F.col("s.at").alias("to")).alias("m")
    )
    return whole.union(single).groupBy("_d", "_k").agg(F.collect_set("m").alias("spans"))


def parse(spans: list, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """start, length, source (id and text hash) and place in it of the factors of a text, in words, from its matches."""
    out: list[list[int]] = []
    growing: dict[tuple, int] = {}
    ordered = sorted((m["at"] >> 20, m["at"] & (1 << 20) - 1, m["sd"], m["sk"], m["to"]) for m in spans)
    for lo, more, sd, sk, to in ordered:
        line = (sd, sk, to - lo)
        i = growing.get(line)
        if i is not None and lo <= out[i][1] + 1:
            out[i][1] = max(out[i][1], lo + more)
        else:
            growing[line] = len(out)
            out.append([lo, lo + more, sd, sk, to])
    return [(lo, hi - lo + length, sd, sk, to) for lo, hi, sd, sk, to in out]


_FACTORS = "_d long, _k long, start long, length long, sd long, sk long, place long"


def factors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The factors of each text: start and length in words, and the source's _d, _k and word at which it holds the same."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d, k, *f) for d, k, spans in zip(*(batch.column(x).to_pylist() for x in ("_d", "_k", "spans")), strict=True) for f in parse(spans, length)]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in _FACTORS.split(", ")])

    return matches(docs, length, gram).mapInArrow(rows, _FACTORS)


_OUT = "_d long, _k long, n_words long, n_removed long, kept string, n_factors long"


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """_d, _k, n_words, n_removed, kept (the words left, joined by a blank, or their SHA-256 without ``keep_text``) and n_factors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, d, k, spans in texts(batches, "_d", "_k", "spans"):
            out: list[list] = [[], [], [], [], [], []]
            for x, dd, kk, here in zip(text, d, k, spans, strict=True):
                starts, ends = runs(~BLANK[np.frombuffer(x, np.uint8)])
                n, gone, found = len(starts), np.zeros(0, np.int64), parse(here or [], length)
                if found:
                    lo = np.array([f[0] for f in found], np.int64)
                    hi = lo + np.array([f[1] for f in found], np.int64)
                    edges = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
                    gone = np.flatnonzero(np.cumsum(edges)[:n])
                words = x.split() if not len(gone) else None
                if words is None:
                    left = np.delete(np.arange(n), gone)
                    words = [x[starts[i] : ends[i]] for i in left.tolist()]
                kept = b" ".join(words)
                for column, value in zip(out, (dd, kk, n, len(gone), kept if keep_text else hashlib.sha256(kept).hexdigest().encode(), len(found)), strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            arrays[4] = arrays[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _OUT.split(", ")])

    spans = stored(matches(docs, length, gram), "spans")
    return matched(keyed(docs), spans, "left").mapInArrow(cut, _OUT)
