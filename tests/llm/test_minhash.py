import random
import re

import pytest

from lectern.llm import minhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, length=2):
    """Components of all pairs, by comparing all of them."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + length]) for i in range(len(w) - length + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        d = -(2**63) if d is None else d
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((-(2**63) if d is None else d), len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("name", ["odd_documents", "documents", "no_documents"])
def test_equals_all_pairs(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = sorted((r._d, r.n, r.component) for r in minhash.near_duplicates(docs).collect())
    assert found == brute(rows)


def near_copies(many):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(many):
        words = list(base)
        for at in rng.sample(range(80), rng.choice([1, 3, 5, 7])):
            words[at] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(words)))
    return rows


def test_large_group_of_near_copies(spark):
    """Many copies that are similar to some others only, so that heads alone don't connect them."""
    rows = near_copies(150)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r._d, r.n, r.component) for r in found) == brute(rows)


def test_pairs_of_a_group_grow_with_its_size(spark, monkeypatch):
    tried = []
    linked = minhash._linked

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return linked(pairs, *rest)

    monkeypatch.setattr(minhash, "_linked", counted)
    totals = []
    for many in (400, 1600):
        tried.clear()
        minhash.near_duplicates(spark.createDataFrame(near_copies(many), "doc_id long, text string")).count()
        totals.append(sum(tried))
    assert totals[1] <= 4 * 1.2 * totals[0]


def test_parities_bound_the_difference():
    rng = random.Random(3)
    for _ in range(50):
        a = {rng.randrange(2**63) for _ in range(rng.randrange(1, 400))}
        b = {x for x in a if rng.random() < 0.9} | {rng.randrange(2**63) for _ in range(rng.randrange(30))}
        x, y = (minhash.parities(minhash.np.array(sorted(s), "u8")) for s in (a, b))
        assert sum(bin(int(i)).count("1") for i in (x ^ y).view("u8")) <= len(a ^ b)


def test_similarity_below_the_lists_is_refused(no_documents):
    with pytest.raises(ValueError):
        minhash.near_duplicates(no_documents, percent=70)
