"""Toxicity: a conditional random field tags toxic spans; marginals give document scores and offending offsets.

Tokens are runs of letters and digits of the lower-cased text. The field's features are hashes of the token, of its
beginnings and of its ending. It is trained here, on at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents of at most
SAMPLE_CHARS characters. Only documents are labelled, so token labels come first: in toxic documents a token is toxic if
one of its features stands in toxic documents far more often than in clean ones, each feature counted once for each
different next token, so that copies of a document count once. A fifth of the sample is kept aside to calibrate document
scores: a logistic curve over the highest marginal and the sum of marginals (forward-backward), with classes weighted as
they occur among all labelled documents.

Inputs of a score are the text's tokens alone. Defined cases: null and empty texts get the score of a text without tokens;
without labels of both kinds the score is the share of toxic labels (0 without any) and no token offends; very long texts
are scored whole (SAMPLE_CHARS bounds what is learnt from alone); ties in the sample go to the smaller id; repeated rows
are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf
from .words import BYTE, mix, run_hashes, runs, slices

SAMPLE_TOXIC = 1500
SAMPLE_CLEAN = 4000
SAMPLE_CHARS = 8000
THRESHOLD = 0.3
#: Feature hashes; the last number stands for none.
SIZE = (1 << 18) + 1
BEGINNINGS = (3, 4, 5, 6, 8)
ENDING = 4
#: A token's evidence: different contexts in toxic documents at least, and times as often as in clean ones.
LEAST_CONTEXTS = 5
LEAST_RATIO = 15.0
_TOKEN = np.zeros(256, bool)
_TOKEN[0x80:] = True
for _char in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _TOKEN[_char] = True
_STEP = np.cumprod(np.full(16, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def lowered(text: bytes) -> bytes:
    """Lower case, code point by code point, so that offsets hold."""
    t = text.decode()
    low = t.lower()
    if len(low) != len(t):
        low = "".join(y if len(y := x.lower()) == 1 else x for x in t)
    return low.encode()


class Tokens:
    """Features of all tokens of some texts; ``texts`` are lower-cased."""

    def __init__(self, texts: list[bytes]):
        whole = b"\n".join(texts) + b"\n" * 8
        a = np.frombuffer(whole, np.uint8)
        self.starts, self.ends = runs(_TOKEN[a])
        #: For each byte how many code points begin before it.
        self.points = np.concatenate([[0], np.cumsum((a & 0xC0) != 0x80)])
        edges = np.cumsum([0, *(len(x) + 1 for x in texts)])
        self.text_starts = edges[:-1]
        self.per_text = np.diff(np.searchsorted(self.starts, edges))
        lengths = self.ends - self.starts
        self.words = run_hashes(a, self.starts, self.ends)
        out = np.full((len(self.starts), len(BEGINNINGS) + 2), SIZE - 1, np.int32)
        out[:, 0] = _slot(self.words, 0)
        h = np.zeros(len(self.starts), np.uint64)
        for n in range(max(BEGINNINGS)):
            h = h + BYTE[a[self.starts + n]] * _STEP[n]
            if n + 1 in BEGINNINGS:
                column = BEGINNINGS.index(n + 1) + 1
                out[:, column] = np.where(lengths > n + 1, _slot(h, column), SIZE - 1)
        h = np.zeros(len(self.starts), np.uint64)
        for n in range(ENDING):
            h = h + BYTE[a[np.maximum(self.ends - 1 - n, 0)]] * _STEP[n]
        out[:, -1] = np.where(lengths > ENDING, _slot(h, 99), SIZE - 1)
        self.features = out


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + np.uint64(kind * 0x632BE59BD9B4E019 % 2**64)) & np.uint64(SIZE - 2)).astype(np.int32)


def _contexts(tokens: Tokens, chosen: np.ndarray) -> np.ndarray:
    """In how many different contexts (next tokens) each feature stands, in the tokens ``chosen``."""
    following = np.concatenate([tokens.words[1:], np.zeros(1, np.uint64)])[chosen]
    out = np.zeros(SIZE, np.int64)
    for column in tokens.features[chosen].T:
        pairs = np.unique(mix(following) + column.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
        out += np.bincount(column[pairs], minlength=SIZE)
    out[SIZE - 1] = 0
    return out


@dataclass
class Scorer:
    field: crf.Model
    curve: np.ndarray | None
    share: float

    def tokens(self, tokens: Tokens) -> np.ndarray:
        """Log-odds of each token being toxic."""
        if self.curve is None:
            return np.full(len(tokens.starts), -40.0)
        return crf.marginals(crf.emissions(self.field, tokens.features), tokens.per_text, self.field)

    def documents(self, odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores from the log-odds of the tokens of documents with so many each."""
        if self.curve is None:
            return np.full(len(lengths), self.share)
        x = _summary(odds, lengths)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def _summary(odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document 1, the highest log-odds and the logarithm of the sum of marginals."""
    p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    text = np.repeat(np.arange(len(lengths)), lengths)
    highest = np.full(len(lengths), -12.0)
    np.maximum.at(highest, text, np.clip(odds, -12, 12))
    return np.stack([np.ones(len(lengths)), highest / 4, np.log(1e-4 + np.bincount(text, p, len(lengths))) / 4], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps of weighted logistic regression with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 0.02 * b
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(len(b))
        b = b + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return b


def fit(texts: list[bytes], toxic: np.ndarray, share: float) -> Scorer:
    """``share``: of toxic among all labels, also those outside the sample."""
    toxic = np.asarray(toxic, bool)
    none = crf.Model(np.zeros(SIZE, np.float32), 0.0, np.zeros((2, 2)), 0.0)
    if not toxic.any() or toxic.all():
        return Scorer(none, None, share)
    aside = np.arange(len(texts)) % 5 == 4
    if not (toxic[aside].any() and toxic[~aside].any() and (~toxic)[aside].any() and (~toxic)[~aside].any()):
        aside[:] = False
    train = np.flatnonzero(~aside)
    tokens = Tokens([lowered(texts[i]) for i in train])
    bad = np.repeat(toxic[train], tokens.per_text)
    found, clean = _contexts(tokens, bad), _contexts(tokens, ~bad)
    ratio = (found / max(bad.sum(), 1)) / ((clean + 0.5) / max((~bad).sum(), 1))
    strong = (found >= LEAST_CONTEXTS) & (ratio >= LEAST_RATIO)
    marks = bad & strong[tokens.features].any(axis=1)
    field = crf.fit(tokens.features, tokens.per_text, marks, SIZE, steps=40)
    kept = Scorer(field, np.zeros(3), share)
    check = np.flatnonzero(aside) if aside.any() else train
    other = Tokens([lowered(texts[i]) for i in check])
    y = toxic[check]
    weight = np.where(y, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    kept.curve = _logistic(_summary(kept.tokens(other), other.per_text), y, weight)
    return kept


def train(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, most_chars: int = SAMPLE_CHARS) -> Scorer:
    """From labels (doc_id, toxic) of documents; of each kind those whose ids hash lowest."""
    known = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("_d"), (F.col("toxic") == 1).alias("bad"))
    share = known.agg(F.avg(F.col("bad").cast("double"))).first()[0] or 0.0
    order = [F.xxhash64("_d"), F.col("_d")]
    chosen = known.filter("bad").orderBy(*order).limit(toxic).union(known.filter("not bad").orderBy(*order).limit(clean))
    rows = docs.select(F.col("doc_id").cast("long").alias("_d"), "text").filter(F.length("text") <= most_chars)
    rows = rows.join(F.broadcast(chosen), "_d").orderBy(*order, "text").limit(toxic + clean).collect()
    rows.sort(key=lambda r: (not r.bad, r._d, r.text))
    return fit([r.text.encode() for r in rows], np.array([r.bad for r in rows]), float(share))


_OUT = "doc_id long, score double, predicted int, spans array<struct<start: int, end: int, p: double>>"
_SPANS = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])


def _offending(tokens: Tokens, odds: np.ndarray, least: float) -> pa.ListArray:
    """For each text its tokens of a marginal of ``least`` or more, with code point offsets."""
    p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    owner = np.repeat(np.arange(len(tokens.per_text)), tokens.per_text)
    hit = np.flatnonzero(p >= least)
    first = tokens.points[tokens.text_starts][owner[hit]]
    places = [tokens.points[x[hit]] - first for x in (tokens.starts, tokens.ends)]
    spans = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in places] + [pa.array(p[hit])], fields=list(_SPANS))
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner[hit], minlength=len(tokens.per_text)))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), spans)


def scores(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, least: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, and spans: toxic tokens with their code point offsets (end exclusive) and marginal."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, part in slices(batches):
            tokens = Tokens([lowered(x) for x in text])
            odds = scorer.tokens(tokens)
            p = scorer.documents(odds, tokens.per_text)
            columns = [part.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), _offending(tokens, odds, least)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, _OUT)


def held_out(doc_id: Column) -> Column:
    """The fold that no score learns from; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))
