"""Quality rules: a conditional random field labels each line as content or boilerplate, and content share decides.

Lines that hold a word are the sequence. A line's features are bins of what is counted on it (words, symbols, separators,
case, digits, sentence ends, repeats). The field is trained here on at most SAMPLE labelled documents of at most
SAMPLE_CHARS characters. Only documents are labelled, so line labels come first: a field of single lines is fitted to the
labels of their documents, and a line gets the label that it finds likelier, so that prose in a bad document is content and
a navigation bar in a good one boilerplate; only the line of a bad document that is least like content always stays
boilerplate. Then ROUNDS times a chain is fitted to these labels, and its marginals label anew. Decoding (Viterbi), counts
and verdicts cover every whole text. Base rules go first: too few words or too many words in repeated three-word windows
reject a document whatever its lines are.

Defined cases: null and empty texts have no words and are rejected by the base rules; without labels every line is content,
so that the base rules alone decide; without bad documents as well; very long texts are counted in pieces and decoded
whole; ties of two labellings go to content; repeated rows are judged alike; an empty table gives no rows; other columns
are ignored by ``verdicts`` and kept by ``good``, whatever they're called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .words import BLANK, PIECE, runs, slices, windows, word_hashes

MIN_WORDS = 50
MOST_REPEATED = 50  # percent
WINDOW = 3
LEAST_CONTENT = 0.5
SAMPLE = 4000
SAMPLE_CHARS = 60_000
ROUNDS = 2
SYMBOLS = b"#*$%&|<>"
_BASE = 0xC2B2AE3D27D4EB4F

_BLANK, _LOWER, _UPPER, _DIGIT, _BAR, _SHOUT, _STOP, _COMMA, _SYMBOL, _OTHER, _REST = range(11)
_CLASS = np.full(256, _OTHER, np.int64)
_CLASS[BLANK] = _BLANK
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[0xC0:] = _LOWER
_CLASS[0x80:0xC0] = _REST
_CLASS[list(SYMBOLS)] = _SYMBOL
for _char, _kind in ((b"|", _BAR), (b"!", _SHOUT), (b".", _STOP), (b",", _COMMA)):
    _CLASS[_char[0]] = _kind

#: Upper bounds of the bins of each feature.
BINS = {
    "words": (1, 3, 7, 15, 31, 63),
    "symbols": (0, 0.02, 0.05, 0.1, 0.2),
    "bars": (0, 0.05, 0.2, 0.4, 0.6),
    "shouts": (0, 0.05, 0.2, 0.5, 0.8),
    "upper": (0, 0.05, 0.12, 0.25, 0.5, 0.8),
    "digits": (0, 0.02, 0.05, 0.2, 0.5),
    "stops": (0, 0.05, 0.1, 0.2, 0.4),
    "commas": (0, 0.05, 0.15, 0.3),
    "word_chars": (2, 3, 4, 5, 6, 8, 12),
    "other": (0, 0.02, 0.05, 0.1, 0.2),
    "same_as_before": (0, 0.05, 0.2, 0.5, 0.8),
    "line_again": (0,),
}
_WIDE = 8
FEATURES = len(BINS) * _WIDE + 1


class Lines:
    """What is counted in some texts, by text and by line that holds a word."""

    def __init__(self, texts: list[bytes]):
        whole = b"\n".join(texts)
        a = np.frombuffer(whole, np.uint8)
        per_text = np.array([x.count(b"\n") + 1 for x in texts], np.int64)
        counts = np.zeros((int(per_text.sum()), 11), np.int64)
        starts, _ = runs(~BLANK[a])
        line_of_word, line = np.zeros(len(starts), np.int64), 0
        for at in range(0, len(a), PIECE):
            part = a[at : at + PIECE]
            ends = part == 0x0A
            number = line + np.cumsum(ends) - ends
            found = np.bincount((number - line) * 11 + _CLASS[part])
            rows = -(-len(found) // 11)
            counts[line : line + rows] += np.pad(found, (0, rows * 11 - len(found))).reshape(rows, 11)
            here = slice(*np.searchsorted(starts, (at, at + len(part))))
            line_of_word[here] = number[starts[here] - at]
            line += int(ends.sum())
        words = np.bincount(line_of_word, minlength=len(counts))
        text_of_line = np.repeat(np.arange(len(texts)), per_text)
        hashes = word_hashes(whole)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (line_of_word[1:] == line_of_word[:-1])
        self.n_words = np.bincount(text_of_line, words, len(texts)).astype(np.int64)
        by_text = np.stack([np.bincount(text_of_line, c, len(texts)) for c in counts.T], axis=1).astype(np.int64)
        self.word_chars = by_text[:, 1:_REST].sum(axis=1)
        self.n_symbols = by_text[:, _SYMBOL] + by_text[:, _BAR]
        again = np.zeros(len(counts), bool)
        at = 0
        for x in texts:
            seen = set()
            for s in x.split(b"\n"):
                if words[at]:
                    again[at] = s in seen
                    seen.add(s)
                at += 1
        self.n_dup_lines = np.bincount(text_of_line, again, len(texts)).astype(np.int64)
        cuts = np.cumsum(self.n_words)[:-1]
        self.n_repeat_words = np.array([_in_repeats(w) for w in np.split(hashes, cuts)], np.int64)
        # features of lines that hold a word
        full = words > 0
        self.per_text = np.bincount(text_of_line[full], minlength=len(texts))
        self.line_words = words[full]
        c, w = counts[full].astype(np.float64), words[full].astype(np.float64)
        chars = c[:, 1:_REST].sum(axis=1)
        letters = np.maximum(c[:, _LOWER] + c[:, _UPPER], 1)
        shares = {
            "words": w,
            "symbols": c[:, _SYMBOL] / chars,
            "bars": c[:, _BAR] / w,
            "shouts": c[:, _SHOUT] / w,
            "upper": c[:, _UPPER] / letters,
            "digits": c[:, _DIGIT] / chars,
            "stops": c[:, _STOP] / w,
            "commas": c[:, _COMMA] / w,
            "word_chars": chars / w,
            "other": c[:, _OTHER] / chars,
            "same_as_before": np.bincount(line_of_word, same, len(counts))[full] / w,
            "line_again": again[full].astype(np.float64),
        }
        self.features = np.stack([i * _WIDE + np.searchsorted(BINS[k], v) for i, (k, v) in enumerate(shares.items())], axis=1)

    def content(self, model: crf.Model) -> np.ndarray:
        """Share of each text's words in lines labelled content; 0 for texts without words."""
        labels = crf.viterbi(crf.emissions(model, self.features), self.per_text, model)
        text = np.repeat(np.arange(len(self.per_text)), self.per_text)
        return np.bincount(text, self.line_words * labels, len(self.per_text)) / np.maximum(self.n_words, 1)

    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MOST_REPEATED * self.n_words)


def _in_repeats(w: np.ndarray) -> int:
    """Words that lie in a window found twice or more."""
    grams = windows(w, WINDOW, _BASE)
    if len(grams) < 2:
        return 0
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    hit = np.concatenate([counts[inverse] > 1, np.zeros(WINDOW - 1, bool)])
    for i in range(1, WINDOW):
        hit[i:] |= np.concatenate([counts[inverse] > 1, np.zeros(WINDOW - 1 - i, bool)])
    return int(hit.sum())


def fit(features: np.ndarray, lengths: np.ndarray, good: np.ndarray) -> crf.Model:
    """The field from the lines of some documents, which are ``good`` or not."""
    good = np.asarray(good, bool)
    of_good = np.repeat(good, lengths)
    if of_good.all():
        return crf.fit(features, lengths, of_good, FEATURES)
    text = np.repeat(np.arange(len(lengths)), lengths)

    def labels(odds: np.ndarray) -> np.ndarray:
        least = np.full(len(lengths), np.inf)
        np.minimum.at(least, text, odds)
        return (odds >= 0) & (of_good | (odds > least[text]))

    model = crf.fit(features, np.ones(len(features), np.int64), of_good, FEATURES)
    odds = crf.emissions(model, features)
    for _ in range(ROUNDS):
        model = crf.fit(features, lengths, labels(odds), FEATURES)
        odds = crf.marginals(crf.emissions(model, features), lengths, model)
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> crf.Model:
    """The field from at most ``most`` labelled documents, those whose ids hash lowest."""
    known = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("_d"), "quality")
    chosen = known.orderBy(F.xxhash64("_d"), "_d", "quality").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("_d"), "text").filter(F.length("text") <= most_chars)
    rows = rows.join(F.broadcast(chosen), "_d").orderBy(F.xxhash64("_d"), "text").limit(most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, part in slices(batches):
            lines = Lines(text)
            found = [x.astype("<i2").tobytes() for x in np.split(lines.features, np.cumsum(lines.per_text)[:-1])]
            yield pa.RecordBatch.from_arrays([part.column("_d"), part.column("quality").cast(pa.int32()), pa.array(found, pa.binary())], ["_d", "quality", "lines"])

    sample = sorted((r._d, r.quality, bytes(r.lines)) for r in rows.mapInArrow(count, "_d long, quality int, lines binary").collect())
    features = np.concatenate([np.zeros((0, len(BINS)), np.int64), *(np.frombuffer(x, "<i2").reshape(-1, len(BINS)).astype(np.int64) for _, _, x in sample)])
    lengths = np.array([len(x) // 2 // len(BINS) for _, _, x in sample], np.int64)
    return fit(features, lengths, np.array([q == 1 for _, q, _ in sample], bool))


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content double, kept boolean"


def verdicts(docs: DataFrame, labels: DataFrame, least: float = LEAST_CONTENT) -> DataFrame:
    """Counts, content share and verdict of every row of ``docs``."""
    model = train(docs, labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, part in slices(batches):
            x = Lines(text)
            content, failed = x.content(model), x.base_failed()
            columns = [x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, failed, content, ~failed & (content >= least)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns)], [c.split()[0] for c in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, _OUT)


def good(docs: DataFrame, labels: DataFrame, least: float = LEAST_CONTENT) -> DataFrame:
    """The rows of ``docs``, as they are, that are kept."""
    model = train(docs, labels)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, part in slices(batches):
            x = Lines(text)
            yield part.filter(pa.array(~x.base_failed() & (x.content(model) >= least)))

    return docs.mapInArrow(choose, docs.schema)
