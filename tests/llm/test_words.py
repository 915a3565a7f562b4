import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import words


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \t\n\x0b\x1c é😀", max_size=60), st.integers(1, 9))
def test_hashes_tell_words_and_windows_apart(text, length):
    found = words.word_hashes(text.encode())
    real = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert len(found) == len(real)
    assert len(set(found.tolist())) == len(set(real))
    grams = [tuple(real[i : i + length]) for i in range(len(real) - length + 1)]
    hashes = words.windows(found, length, 0xD6E8FEB86659FD93).tolist()
    assert len(hashes) == len(grams)
    assert len(set(hashes)) == len(set(grams)) == len(set(zip(hashes, grams, strict=True)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 12))
def test_first_minimum(values, length):
    v = np.array(values, np.uint64)
    expected = [i + int(np.argmin(v[i : i + length])) for i in range(len(v) - length + 1)]
    assert words.first_minimum(v, length).tolist() == expected


def test_pieces_do_not_change_hashes(monkeypatch):
    data = " ".join(f"word{i}" for i in range(1000)).encode()
    whole = words.word_hashes(data)
    monkeypatch.setattr(words, "PIECE", 37)
    assert words.word_hashes(data).tolist() == whole.tolist()
