import hashlib
import random
import re
from collections import Counter

import pytest

from lectern.llm import substrings
from lectern.llm.shared import keyed


def brute(rows, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((-(2**63) if d is None else d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("name", ["odd_documents", "documents", "no_documents"])
def test_equals_all_windows(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = sorted((r._d, r.n_words, r.n_removed, r.kept) for r in substrings.deduplicated(docs, keep_text=False).collect())
    assert found == brute(rows, 35)


def test_short_windows(odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    kept = {(r._d, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.deduplicated(odd_documents, 9, 4).collect()}
    assert kept == set(brute(rows, 9))


@pytest.mark.parametrize("name", ["odd_documents", "documents", "no_documents"])
def test_factors(request, name):
    """Every factor stands in its source, at another place, and together they cover what is removed; neighbours don't go on in one source."""
    docs = request.getfixturevalue(name)
    texts = {(r._d, r._k): re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in keyed(docs).collect()}
    repeated = {k for k, n in Counter((r._d, r._k) for r in keyed(docs).collect()).items() if n > 1}
    covered = {}
    for f in substrings.factors(docs).collect():
        own, source = texts[f._d, f._k], texts[f.sd, f.sk]
        assert f.length >= 35 and own[f.start : f.start + f.length] == source[f.place : f.place + f.length]
        assert (f._d, f._k, f.start) != (f.sd, f.sk, f.place) or (f._d, f._k) in repeated
        covered.setdefault((f._d, f._k), set()).update(range(f.start, f.start + f.length))
    for r in substrings.deduplicated(docs).collect():
        assert r.n_removed == len(covered.get((r._d, r._k), ()))


def test_a_copy_is_one_factor(spark):
    rng = random.Random(8)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(500))
    other = " ".join(str(rng.randrange(10**6)) for _ in range(100))
    rows = [(1, text), (2, text), (3, f"{other} {text} {other[::-1]}"), (4, f"{text[:1500]} {other}")]
    got = sorted((f._d, f.start, f.length, f.sd, f.place) for f in substrings.factors(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert (2, 0, 500, 1, 0) in got and (3, 100, 500, 1, 0) in got
    assert [g[2:] for g in got if g[0] == 4 and g[3] == 3] == [(100, 3, 0)]
