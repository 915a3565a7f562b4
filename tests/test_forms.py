"""Normal forms against ``unicodedata`` on all code points, and in the rules that use them."""

import sys
import unicodedata

from pyspark.sql import functions as F

from lectern.functions import forms
from lectern.functions import text as T


def test_all_code_points(spark):
    every = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) not in ("Cn", "Co")]
    texts = [(i, "|".join(every[i : i + 200])) for i in range(0, len(every), 200)]
    rows = spark.createDataFrame(texts, "n long, s string").repartition(8)
    for r in rows.select("s", forms.nfkd(F.col("s")).alias("k"), forms.casefolded(F.col("s")).alias("c")).collect():
        assert r.k == unicodedata.normalize("NFKD", r.s) and r.c == r.s.casefold()


def test_plain_null_and_long(spark):
    long = "Straße ﬁn " * 20_000
    rows = [(None,), ("",), ("Plain ASCII",), (long,)]
    got = spark.createDataFrame(rows, "s string").select(forms.nfkd(F.col("s")).alias("k"), forms.casefolded(F.col("s")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(None, None), ("", ""), ("Plain ASCII", "plain ascii"), (long.replace("ﬁ", "fi"), long.casefold())]


def test_rules_with_ligatures_and_accents(spark):
    row = spark.createDataFrame([("Eﬃcient puriﬁcation of 5 µM Café–Water", "Efﬁciency of Müller's x²")], "a string, b string")
    got = row.select(T.evidence_norm(F.col("a")), T.title_norm(F.col("b")), T.text_norm(F.col("b")), T.folded(F.lit("Straße ΣΑΣ ŉ"))).first()
    assert tuple(got) == ("efficient purification of 5 μm café-water", "efficiency of mu ller s x2", "efficiencyofmullersx2", "strasse σασ ʼn")
    held = row.select(T.evidence_norm(F.col("a")).contains(T.evidence_norm(F.lit("PURIFICATION  of")))).first()
    assert held[0]
