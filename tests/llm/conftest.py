import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _d string, text_ string, size long, c long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty texts, repeated rows, near copies, a very long text, ties and columns with clashing names."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["été", "straße", "A", "a.b", "x y", "z z"]
    rows = [(None, None, None, None), (1, None, "en", "s0"), (2, "", "en", "s0"), (3, " \t\n\x0b ", "de", None), (4, "one", None, "s1"), (5, "One", None, "s1")]
    for i in range(6, 60):
        words = rng.choices(vocabulary, k=rng.choice([2, 4, 5, 40, 90, 200]))
        rows.append((i, "".join(w + rng.choice(" \n\t ") for w in words), "en", f"s{i % 4}"))
    base = rng.choices(vocabulary, k=300)
    for i in range(60, 80):
        words = list(base)
        for _ in range(rng.randint(0, 25)):
            words[rng.randrange(300)] = rng.choice(vocabulary)
        rows.append((i, " ".join(words), "fr", "s1"))
    passage = " ".join(rng.choices(vocabulary, k=70))
    rows += [(80 + i, f"{rows[10 + i][1]} {passage} {rows[20 + i][1]}", "en", "s2") for i in range(5)]
    rows.append((90, " ".join(["Ble"] * 500), "en", "s0"))
    rows.append((91, " ".join(rng.choices(vocabulary, k=60_000)), "en", "s3"))
    rows += [rows[12], rows[12], rows[85 - 6]]
    rows.append((92, rows[13][1], "en", "s9"))
    rows.append((13, "another text of a doc_id that is there twice " * 9, "en", "s0"))
    full = [(i, t, lang, s, None if t is None else len(t), "clash", "clash", -1, -2) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
