"""Case folding takes the cheap way only where it gives the same."""

import sys

from pyspark.sql import functions as F

from lectern.functions.forms import casefolded
from lectern.operators import spans as S


def test_every_character_folds(spark):
    # Spark's Unicode tables may be older than Python's: what only lower() would change goes the full way, so nothing else is lowered
    chars = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and chr(i).isprintable()]
    rows = [("A" + "".join(chars[i : i + 1]),) for i in range(len(chars)) if chars[i].casefold() != chars[i] or chars[i].lower() != chars[i]]
    rows += [("A" + "".join(x for x in chars[i : i + 500] if x.casefold() == x and x.lower() == x) + "Z",) for i in range(0, len(chars), 500)]
    found = spark.createDataFrame(rows, "t string").select("t", casefolded(F.col("t")).alias("f")).collect()
    assert [r.t for r in found if r.f != r.t.casefold()] == []


def test_texts_are_normalised_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(S, "written", lambda df, name, real=S.written: made.append((name, df.columns)) or real(df, name))
    cases = spark.createDataFrame([(1, "of two long words"), (2, "one"), (3, "x")], "case_id long, gold string")
    chunks = spark.createDataFrame([(1, "Of TWO long  words"), (2, "one"), (3, None)], "id long, text string")
    found = S.holding(cases, chunks)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 2)]
    assert made == [("normal", ["id", "t"])]
    assert "regexp_replace" not in found.select("id")._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
