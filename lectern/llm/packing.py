"""Best-fit packing of tokenized documents into sequences, with the best-two-fit exchange.

Documents become token ids and an end id; what is longer than a sequence is cut into full pieces, the first taking the
remainder. Pieces are dealt at random into groups of about GROUP pieces, each packed by one task over a histogram of
lengths: a bin takes the longest unpacked piece and then, again and again, the longest that fits; where a gap remains,
its smallest piece is replaced by the two unpacked ones that fill the expanded gap more tightly than it did, if there are
any. A group leaves one sequence that is not nearly full at most, so more groups cost next to nothing, and no task grows
with the input.

Token ids are those of the ``tokenizers`` file. They are computed with ``tiktoken`` over the ranks of the same vocabulary,
which takes a third of the CPU time; texts that hold a special token's string go through ``tokenizers`` itself.

Defined cases: a null text counts as empty and becomes its end id alone; repeated rows are packed each by itself and dealt
like any (by a number drawn for each piece and written with it); ties of length go to the smaller doc_id; a very long text
is one row, tokenized in one worker; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .words import texts

MAX_TOKENS = 1024
END_ID = 2
GROUP = 50_000
SEED = 17
VOCABULARY = "byte_bpe_50k"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of texts as the ``tokenizers`` file of that name gives them."""

    def __init__(self, name: str = VOCABULARY):
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [x.content for x in self.whole.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> list[int]:
        if any(x in text for x in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, most: int = MAX_TOKENS, end: int = END_ID, name: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """PIECES of every row, and with ``keep_ids`` their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(name)
        for text, doc in texts(batches, "doc_id"):
            out: list[list] = [[], [], [], [], [], []]
            for d, t in zip(doc, text, strict=True):
                ids = np.array([*encode(t.decode()), end], "<u4")
                cuts = [0, *range(len(ids) - (len(ids) - 1) // most * most, len(ids), most), len(ids)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip(out, (d, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b] if keep_ids else None), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], types[:n], strict=True)], names[:n])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, PIECES + (", ids array<int>" if keep_ids else ""))


def fill(lengths: np.ndarray, most: int = MAX_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, no bin over ``most``."""
    queues = np.argsort(lengths, kind="stable")
    bounds = np.searchsorted(lengths[queues], np.arange(most + 2))
    left = np.diff(bounds)  # unpacked pieces of each length
    taken = bounds[:-1].copy()
    ladder = np.arange(most + 1)

    def best() -> np.ndarray:
        """For each gap the longest unpacked length that fits it, 0 for none."""
        return np.maximum.accumulate(np.where(left > 0, ladder, 0))

    fits, bins, rest = best(), [], len(lengths)
    while rest:
        content, gap = [], most
        while gap and (size := int(fits[gap])):
            many = min(int(left[size]), gap // size)
            content += [size] * many
            gap -= size * many
            left[size] -= many
            rest -= many
            if not left[size]:
                fits = best()
        if gap and rest and len(content) > 1:
            small = content[-1]
            room = gap + small
            first = np.flatnonzero(left[1 : room]) + 1
            if len(first):
                second = fits[room - first]
                # the same piece can't be taken twice
                alone = (second == first) & (left[first] < 2)
                if alone.any():
                    second[alone] = [int(fits[x - 1]) for x in first[alone]]
                total = np.where(second > 0, first + second, 0)
                at = int(total.argmax())
                if total[at] > small:
                    a, b = int(first[at]), int(second[at])
                    content[-1:] = [a, b]
                    left[a] -= 1
                    left[b] -= 1
                    left[small] += 1
                    rest -= 1
                    fits = best()
        bins.append(content)
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, content in enumerate(bins):
        at = 0
        for size in content:
            row = queues[taken[size]]
            taken[size] += 1
            number[row], offset[row] = i, at
            at += size
    return number, offset


def _written(rows: DataFrame) -> DataFrame:
    """``rows`` with a number in [0, 1) for each, written, so that equal rows are dealt apart and reruns of a task agree."""
    return stored(rows.withColumn("_deal", F.rand(SEED)), "pieces")


def pack(rows: DataFrame, most: int = MAX_TOKENS, group: int = GROUP) -> DataFrame:
    """``rows`` (``_written`` pieces) with sequence_id and offset."""

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "start"], kind="stable")
        number, offset = fill(part["length"].to_numpy(), most)
        return part.assign(sequence_id=number + (int(key[0]) << 32), offset=offset)[names]

    groups = max(1, -(-rows.count() // group))
    dealt = rows.withColumn("_group", F.floor(F.col("_deal") * groups).cast("int")).drop("_deal")
    names = [x for x in dealt.columns if x != "_group"] + ["sequence_id", "offset"]
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema if x.name != "_deal") + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInPandas(one, schema)


def packed(docs: DataFrame, most: int = MAX_TOKENS, end: int = END_ID, name: str = VOCABULARY, group: int = GROUP) -> DataFrame:
    """PIECES, sequence_id and offset of every piece of ``docs``."""
    return pack(_written(pieces(docs, most, end, name)), most, group)


def sequences(docs: DataFrame, most: int = MAX_TOKENS, end: int = END_ID, name: str = VOCABULARY, group: int = GROUP) -> DataFrame:
    """sequence_id and its ids, the pieces one after the other."""
    rows = pack(_written(pieces(docs, most, end, name, keep_ids=True)), most, group)
    parts = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))
