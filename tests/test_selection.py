"""Selections: what is left out before the fold over a topic is never picked by it."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.functions import inventory as I
from lectern.operators import corpus as C
from lectern.operators import retrieval as R

SCHEMA = "id long, topic string, author string, journal string, year int, review boolean, level string, score double"


def plain(rows, target):
    """The five passes over all candidates of each topic."""
    recent_target, review_cap, out = max(2, round(target * C.RECENT_SHARE)), max(2, round(target * C.REVIEW_SHARE)), set()
    for topic in {r[1] for r in rows}:
        pool = sorted((r for r in rows if r[1] == topic), key=lambda r: (-r[7], r[0]))
        picked, authors, journals = [], Counter(), Counter()
        for n in range(1, 6):
            for r in pool:
                _, _, author, journal, year, review, level, _ = r
                recent = sum((x[4] or 0) >= C.RECENT_YEAR for x in picked)
                if len(picked) >= (target - recent_target if n == 1 else target) or n == 2 and recent >= recent_target:
                    break
                asked = (level == "A", (year or 0) >= C.RECENT_YEAR, level == "B", topic == "hard_negative", True)[n - 1]
                if r in picked or not asked or author and authors[author] >= C.PER_AUTHOR or journal and journals[journal] >= C.PER_JOURNAL:
                    continue
                if n <= 3 and review and sum(bool(x[5]) for x in picked) >= review_cap:
                    continue
                picked.append(r)
                authors[author] += 1
                journals[journal] += 1
        out |= {(r[0], i + 1) for i, r in enumerate(picked)}
    return out


@pytest.mark.parametrize("seed, authors, journals, target", [(1, 400, 90, 20), (2, 6, 3, 20), (3, 30, 2, 9), (4, 2, 40, 41)])
def test_quota_selection_equals_all_candidates(spark, seed, authors, journals, target):
    rng, rows = random.Random(seed), []
    for i in range(2500):
        author = rng.choice([None, "", *(f"a{int(authors * rng.random() ** 3)}" for _ in range(12))])
        journal = rng.choice([None, "", *(f"j{int(journals * rng.random() ** 2)}" for _ in range(12))])
        topic = rng.choice(["t", "t", "t", "u", "hard_negative"])
        rows.append((i, topic, author, journal, rng.choice([None, *range(2000, 2026)]), rng.choice([None, True, False]), rng.choice("AB-"), round(rng.random(), 2)))
    got = C.quota_selection(spark.createDataFrame(rows, SCHEMA), target).collect()
    assert {(r.id, r.pick) for r in got} == plain(rows, target)


def test_a_topic_is_bounded_by_caps(spark):
    """A topic of a million candidates by very many authors reaches the fold with as many as its caps allow."""
    rows = spark.range(1_000_000).select(
        "id", F.lit("t").alias("topic"), F.concat(F.lit("a"), (F.col("id") % 300_007).cast("string")).alias("author"),
        F.concat(F.lit("j"), (F.col("id") % 5003).cast("string")).alias("journal"), F.lit(2020).alias("year"), (F.col("id") % 2 == 0).alias("review"),
        F.lit("A").alias("level"), (F.xxhash64("id") % 1000 / 1000).alias("score"),
    )
    left = C.reachable(rows, 20, [F.col("level").alias("level"), F.col("review").alias("review")])
    assert left.count() <= 2 * (20 + 6 * 6 + 28)
    assert C.quota_selection(rows, 20).count() == 20


def test_layout_title(spark):
    """Largest run of lines: boilerplate and mastheads aside, near sizes together, a gap ends it, whole pages where nothing is above."""

    def page(*lines, height=800.0):
        return height, [None if x is None else (x[0], [(x[1], x[2])]) for x in lines]

    pages = [
        page((300.0, "and its second line here", 17.6), (20.0, "Water Research", 30.0), (280.0, "The first line of a title,", 18.0), (330.0, "Body text of a paper", 9.0)),
        page((100.0, "A title in one line.", 18.0), (154.0, "Too far below to be of it", 18.0)),
        page((100.0, "A title in one line.", 18.0), (153.9, "near enough to be of it", 18.0)),
        page((700.0, "A title at the bottom", 12.0)),
        page((100.0, "Body in the upper part", 9.0), (700.0, "Large but at the bottom", 20.0)),
        page((100.0, "Short one", 18.0), None),
        page((100.0, None, None)),
        page((549.9, "Page without height", 12.0), (551.0, "beyond its upper part", 30.0), height=None),
        (800.0, None),
    ]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "i int, h double, lines array<struct<y double, spans array<struct<text string, size double>>>>")
    got = [r.t for r in table.select("i", I.layout_title(F.col("lines"), F.col("h")).alias("t")).orderBy("i").collect()]
    assert got == [
        "The first line of a title, and its second line here", "A title in one line", "A title in one line. near enough to be of it", "A title at the bottom",
        "Body in the upper part", "", "", "Page without height", "",
    ]
    several = spark.sql("select array(named_struct('y', 1.0D, 'spans', array(named_struct('text', 'Two sp', 'size', 8.0D), named_struct('text', 'ans of a line', 'size', 14.0D)))) as lines")
    assert several.select(I.layout_title(F.col("lines"))).first()[0] == "Two spans of a line"


def grams(text):
    s = "".join((text or "").split()).lower()
    return {s[i : i + 3] for i in range(len(s) - 2)} if len(s) > 3 else {s} - {""}


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """Comparing texts costs by pairs, not by bytes: a task gets so many of them, and a text's grams are made once a pair."""
    monkeypatch.setattr(R, "PAIR_PART", 20)
    r = random.Random(5)
    texts = ["ozone and the membrane flux at pH 7", "Ozone and the membrane flux at pH 7 ", "ozone and the membrane flux at pH 7.", "dose", "", None, "DOSE of it"]
    rows = [(q, n, f"{q}-{n}", r.choice("st"), r.choice([1, 2, 3, 9, None]), r.choice(texts)) for q in range(30) for n in range(12)]
    n_pairs, wanted = 0, []
    for q in range(30):
        mine, chosen = [x for x in rows if x[0] == q], []
        near = lambda x, y: x[3] == y[3] and None not in (x[4], y[4]) and abs(x[4] - y[4]) <= 1
        alike = lambda x, y: near(x, y) and len(grams(x[5]) & grams(y[5])) >= 0.9 * len(grams(x[5]) | grams(y[5]))
        n_pairs += sum(near(x, y) for x in mine for y in mine if x[1] < y[1])
        for x in mine:
            if len(chosen) < R.TOP_K and sum(x[3] == c[3] for c in chosen) < R.MAX_PER_SOURCE and not any(alike(c, x) for c in chosen):
                chosen.append(x)
        wanted += [(q, i, x[2]) for i, x in enumerate(chosen)]
    found = R.diversify(spark.createDataFrame(rows, "query_id int, rank int, id string, source string, chunk_index int, text string"))
    assert sorted((x.query_id, x.rank, x.id) for x in found.collect()) == sorted(wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-n_pairs // 20)}), REPARTITION_BY_NUM" in plan
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
