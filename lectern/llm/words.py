"""Vectorised word and shingle hashing over UTF-8 bytes: no Python object is made for a word.

Words are runs of anything but the blanks 0x20 and 0x09-0x0D, as everywhere in this subpackage. Hashes are stable
between processes and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(7_045_113)
#: A random odd number for each byte value.
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Offsets inside a word wrap here; the word's length is hashed too.
_WRAP = 1 << 16
_MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS = np.full(_WRAP, _MULTIPLIER, np.uint64)
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS, dtype=np.uint64)
#: Texts are hashed in pieces of about so many bytes, cut at blanks.
PIECE = 1 << 21
#: Rows and bytes of text handled at once in a worker (one text at least), so that a batch doesn't multiply in memory.
ROWS = 512


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


def run_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each run of bytes; runs are in order and don't touch."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.arange(int(lengths.sum()), dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    offset = at - np.repeat(first, lengths)
    values = BYTE[a[offset + np.repeat(starts, lengths)]] * _POWERS[offset & (_WRAP - 1)]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > PIECE:
        end = at + PIECE
        while end < len(data) and not BLANK[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def word_hashes(data: bytes) -> np.ndarray:
    out = []
    for piece in _pieces(data):
        a = np.frombuffer(piece, np.uint8)
        out.append(run_hashes(a, *runs(~BLANK[a])))
    return out[0] if len(out) == 1 else np.concatenate(out)


def windows(values: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of each ``length`` consecutive values, by doubling; empty where there are fewer."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, size, part = np.zeros(n, np.uint64), 0, 1, values
    while True:
        if length & size:
            out = out * np.uint64(pow(base, size, 2**64)) + part[done : done + n]
            done += size
        if size * 2 > length:
            return mix(out)
        part = part[:-size] * np.uint64(pow(base, size, 2**64)) + part[size:]
        size *= 2


def first_minimum(values: np.ndarray, length: int) -> np.ndarray:
    """Place of the leftmost minimum of each ``length`` consecutive values."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place, size = np.arange(len(values)), 1

    def lower(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(values[y] < values[x], y, x)

    while size * 2 <= length:
        place = lower(place[:-size], place[size:])
        size *= 2
    return lower(place[:n], place[length - size : length - size + n])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], pa.RecordBatch]]:
    """The texts as UTF-8 (a null text as empty) of some rows, and these rows."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            n = min(max(int(np.searchsorted(sizes, before + PIECE, side="right")) - at, 1), ROWS)
            part = batch.slice(at, n)
            yield [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()], part
            at += n


def texts(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """The texts of some rows as UTF-8, then the named columns."""
    for text, part in slices(batches):
        yield text, *(part.column(x).to_pylist() for x in names)
