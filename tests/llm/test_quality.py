import random
import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


@pytest.mark.parametrize("name", ["odd_documents", "documents", "no_documents"])
def test_base_counts(request, labels, name, monkeypatch):
    docs = request.getfixturevalue(name)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    found = quality.verdicts(docs, labels).collect()
    assert sorted((tuple(r)[:7] for r in found), key=key) == sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=key)
    assert not any(r.kept and r.base_failed for r in found)


def test_pieces(monkeypatch):
    text = "Ab cd | ef.\n\nfoo! #bar é\nAb cd | ef.\n" * 9
    whole = quality.Lines([text.encode(), b"", b"x"])
    monkeypatch.setattr(quality, "PIECE", 7)
    parts = quality.Lines([text.encode(), b"", b"x"])
    assert parts.features.tolist() == whole.features.tolist()
    assert (parts.n_words.tolist(), parts.n_symbols.tolist()) == (whole.n_words.tolist(), whole.n_symbols.tolist())


def test_accuracy_and_pass_through(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.good(docs, marks).collect()}
    assert kept == {r.doc_id for r in quality.verdicts(docs, marks).filter("kept").collect()}
    rows = {r.doc_id: r for r in quality.verdicts(docs, marks).collect()}
    good = [d for d, q in ((r.doc_id, r.quality) for r in marks.collect()) if q == 1 and not rows[d].base_failed]
    bad = [d for d, q in ((r.doc_id, r.quality) for r in marks.collect()) if q == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    assert sum(d not in kept for d in bad) >= 0.9 * len(bad)


def test_without_labels(odd_documents, labels):
    rows = quality.verdicts(odd_documents, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in rows)


def prose(rng, n=14):
    return " ".join(rng.choice(["river", "stone", "walked", "slowly", "evening", "garden", "between", "letters", "window", "harbour"]) for _ in range(n)) + "."


def bar(rng, n=6):
    return " | ".join(rng.choice(["HOME", "LOGIN", "CART", "SHARE", "MENU", "ABOUT"]) for _ in range(n))


def test_lines_of_one_text_are_labelled_apart():
    """Bad documents hold prose too, good ones a bar now and then; the share of words in content lines decides."""
    rng = random.Random(4)
    texts, good = [], []
    for i in range(400):
        bad = i % 5 == 0
        lines = [bar(rng) if rng.random() < (0.75 if bad else 0.05) else prose(rng) for _ in range(rng.randint(8, 20))]
        texts.append("\n".join(lines + [bar(rng)] * bad).encode())
        good.append(not bad)
    lines = quality.Lines(texts)
    model = quality.fit(lines.features, lines.per_text, np.array(good))
    for most in (0, 3, 6, 9, 12):
        page = [prose(rng) for _ in range(6)] + [bar(rng) for _ in range(most)] + [prose(rng) for _ in range(6)]
        x = quality.Lines(["\n".join(page).encode()])
        labels = quality.crf.viterbi(quality.crf.emissions(model, x.features), x.per_text, model)
        assert labels.tolist() == [True] * 6 + [False] * most + [True] * 6
        words = [len(s.split()) for s in page]
        share = sum(n for n, c in zip(words, labels) if c) / sum(words)
        assert abs(x.content(model)[0] - share) < 1e-12
    mostly_bars = quality.Lines(["\n".join([prose(rng)] + [bar(rng) for _ in range(12)] + [prose(rng)]).encode()])
    assert 0 < mostly_bars.content(model)[0] < quality.LEAST_CONTENT
