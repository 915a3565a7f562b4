import re
from collections import defaultdict

import pytest

from lectern.llm import boilerplate
from lectern.llm.shared import keyed

BLANK = "\x20\t\n\x0b\x0c\r"


def brute(rows, least):
    sites, first = defaultdict(set), {}
    for d, k, text, source in rows:
        for i, line in enumerate((text or "").split("\n")):
            if x := line.strip(BLANK):
                sites[x].add(source)
                first[x] = min(first.get(x, (d, k, i)), (d, k, i))
    out = []
    for d, k, text, _ in rows:
        if text is None:
            out.append((d, None, 0, 0))
            continue
        lines = text.split("\n")
        gone = [i for i, x in enumerate(lines) if (b := x.strip(BLANK)) and len(sites[b] - {None}) >= least and first[b] != (d, k, i)]
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("name", "least"), [("odd_documents", 2), ("odd_documents", 3), ("documents", 3), ("documents", 10), ("no_documents", 3)])
def test_equals_exact_counts(request, name, least):
    docs = request.getfixturevalue(name)
    rows = [(r._d, r._k, r.text, r.source) for r in keyed(docs, "source").collect()]
    found = boilerplate.deduplicated(docs, least).collect()
    assert sorted(((-(2**63) if r.doc_id is None else r.doc_id, r.text, r._n_lines, r._n_removed) for r in found), key=repr) == brute(rows, least)
    assert docs.columns == boilerplate.deduplicated(docs, least).columns[:-2]
    if "_d" in docs.columns:
        assert all(r["_d"] == "clash" for r in found)


def test_far_above_the_threshold(spark):
    rows = [(i, f"own {i}\nAll rights reserved.\n  All rights reserved.\t", f"s{i % 50}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in boilerplate.deduplicated(docs, 10).collect()}
    assert found[0].text == "own 0\nAll rights reserved." and found[7].text == "own 7" and found[7]._n_removed == 2


def test_plan_has_no_python(documents):
    plan = boilerplate.deduplicated(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_long_text_that_loses_many_lines(spark):
    lines = [f"line {i}" for i in range(60_000)]
    rows = [(i, "\n".join(lines if i in (0, 99) else ["own"]), f"s{i}") for i in range(100)] + [(100 + i, "\n".join(lines[:30_000]), f"s{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    found = {r.doc_id: r for r in boilerplate.deduplicated(docs, 10).filter("doc_id in (0, 99)").collect()}
    assert found[0]._n_removed == 0 and found[99].text.split("\n") == lines[30_000:]
