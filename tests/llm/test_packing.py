import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import packing

ENCODE = packing.Encoder()
EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet=" \n\t\r\xa0　'sTté😀a1!.<|>", max_size=60))
def test_ids_are_those_of_tokenizers(text):
    for t in (text, f"{text}<|endoftext|>{text}"):
        assert ENCODE(t) == EXACT.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_fill_places_every_piece_once(lengths):
    number, offset = packing.fill(np.array(lengths, np.int64), 50)
    for b in set(number.tolist()):
        rows = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if number[i] == b)
        at = 0
        for o, n in rows:
            assert o == at
            at += n
        assert at <= 50
    if lengths:
        assert sum(lengths) > (len(set(number.tolist())) - 1) * 25


def test_two_fit_improves():
    # the longest that fits leaves a gap: 6 + 3 of 10; then 3 is replaced by 2 + 2
    number, _ = packing.fill(np.array([6, 3, 2, 2, 7]), 10)
    assert len(set(number.tolist())) == 2


@pytest.mark.parametrize("name", ["odd_documents", "documents", "no_documents"])
def test_pieces_and_sequences(request, name):
    docs = request.getfixturevalue(name)
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = packing.packed(docs).collect()
    expected = []
    for d, t in texts:
        ids = EXACT.encode(t, add_special_tokens=False).ids + [2]
        first = len(ids) - (len(ids) - 1) // 1024 * 1024
        cuts = [0, first, *range(first + 1024, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            assert 0 < b - a <= 1024
            expected.append((d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
        assert sum(x[3] for x in expected if x[0] == d) >= len(ids)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(expected, key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(bins) <= max(total / 1024 * 1.04 + 1, 1 if rows else 0)


def test_sequences_hold_the_ids(documents):
    docs = documents.limit(40)
    ids = {tuple(EXACT.encode(r.text or "", add_special_tokens=False).ids + [2])[-1024:] for r in docs.collect()}
    found = [tuple(r.ids) for r in packing.sequences(docs).collect()]
    assert all(any(x == s[i : i + len(x)] for s in found for i in range(len(s))) for x in list(ids)[:5])


def test_equal_rows_are_dealt_apart(spark):
    rows = spark.range(100_000, numPartitions=8).select(*(packing.F.lit(v).cast(t).alias(n) for n, t, v in
        (("doc_id", "long", 1), ("piece", "int", 0), ("start", "long", 0), ("length", "long", 100), ("ids_crc32", "long", 5))))
    placed = packing.pack(packing._written(rows), group=1000)
    groups = placed.groupBy(packing.F.shiftright("sequence_id", 32).alias("g")).count().collect()
    assert len(groups) == 100 and max(g["count"] for g in groups) < 1300 and sum(g["count"] for g in groups) == 100_000


def plain(lengths, most):
    """The contents of the bins by the same rules, over a sorted list of pieces."""
    rest, bins = sorted(lengths), []

    def longest(gap):
        fits = [x for x in rest if x <= gap]
        return fits[-1] if fits else 0

    while rest:
        content, gap = [], most
        while size := longest(gap):
            content.append(size)
            rest.remove(size)
            gap -= size
        if gap and rest and len(content) > 1:
            small, best = content[-1], (content[-1], None)
            for first in sorted(set(rest)):
                others = list(rest)
                others.remove(first)
                second = max((x for x in others if first + x <= gap + small), default=0)
                if second and first + second > best[0]:
                    best = (first + second, (first, second))
            if best[1]:
                content[-1:] = best[1]
                rest.append(small)
                for x in best[1]:
                    rest.remove(x)
                rest.sort()
        bins.append(content)
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(40, 70))
def test_fill_equals_the_plain_exchange(lengths, most):
    number, _ = packing.fill(np.array(lengths, np.int64), most)
    bins = {}
    for b, n in zip(number.tolist(), lengths, strict=True):
        bins.setdefault(b, []).append(n)
    assert sorted(sorted(x) for x in bins.values()) == sorted(sorted(x) for x in plain(lengths, most))
