import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lectern.llm import queries, runs


def plain(words):
    """Every stretch of every period, by comparing words q apart; a stretch belongs to its smallest period."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - at >= max(6, 4 * q):
                out.setdefault((at, end + q - at), q)
            at = end
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh"])
def test_runs_of_random_words(letters):
    rng = random.Random(letters)
    texts = []
    for _ in range(300):
        words = rng.choices(letters, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            period = rng.choices(letters, k=rng.randint(1, 9))
            words[at:at] = (period * 9)[: rng.randint(3, 9) * len(period)]
        texts.append([x.encode() for x in words])
    assert runs.runs_of([runs.numbered(x) for x in texts]) == [plain(x) for x in texts]


def test_small_steps_of_candidates(monkeypatch):
    rng = random.Random(3)
    texts = [[b"x"] * 500, rng.choices([b"a", b"b"], k=700), [b"p", b"q", b"r"] * 90]
    whole = runs.runs_of([runs.numbered(x) for x in texts])
    monkeypatch.setattr(runs, "CANDIDATES", 37)
    assert runs.runs_of([runs.numbered(x) for x in texts]) == whole == [plain(x) for x in texts]


def test_nothing_across_texts():
    word = [b"a", b"b"]
    assert runs.runs_of([runs.numbered(word * 2), runs.numbered(word * 2)]) == [[], []]
    assert runs.runs_of([runs.numbered([]), runs.numbered(word * 4), runs.numbered([])]) == [[], [(0, 8, 2)], []]
    assert runs.runs_of([]) == []


def test_names_and_extensions():
    words = np.array([1, 2, 1, 2, 1, 3, 1, 2, 1, 2, 1])
    names = runs.Names(words)
    at = np.array([0, 0, 1]), np.array([2, 6, 7])
    assert names.ahead(*at).tolist() == [3, 5, 4] and names.behind(np.array([5, 4]), np.array([11, 10])).tolist() == [5, 4]


def test_a_long_text_of_one_period():
    """200,000 words with a period of 40,000, and one word over and over."""
    rng = np.random.default_rng(1)
    period = rng.integers(0, 10**6, 40_000)
    assert runs.runs_of([np.tile(period, 5)]) == [[(0, 200_000, 40_000)]]
    assert runs.runs_of([np.zeros(200_000, np.int64)]) == [[(0, 200_000, 1)]]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    start, length, period = best or (None,) * 3
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(found), start, length, period, best and 1000 * length // period, sha(lines), sha(kept)


def test_query_against_brute_force(spark, odd_documents, tmp_path):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect() if len(r.text or "") < 100_000]
    rows += [(100 + i, "la " * i + "tra la la " * (i % 7)) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected(*r)) for r in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)


def test_whole_rows(odd_documents, no_documents):
    rows = runs.periodic_runs(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    of = {r.doc_id: r for r in rows}
    assert of[1].n_words == 0 and of[1].runs == [] and of[1].collapsed == ""
    assert of[90].runs == [(0, 500, 1)] and of[90].collapsed == "Ble" and of[91].n_words == 60_000
    assert runs.periodic_runs(no_documents).collect() == []
