"""Papers' types, authors and journals, services' answers, splits, bars, first tokens: single cases with answers from the rules."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import inventory as I
from lectern.functions import payloads as Y
from lectern.operators import metrics as M
from lectern.operators import monitor as W
from lectern.sources.reports import block_bar

BODY = "word " * 2000


@pytest.mark.parametrize(("first", "whole", "pages", "kind"), [
    ("Access denied", "Access denied " + BODY, 2, "error_or_login_page"),
    ("Access denied", "Access denied " + "x" * 5000, 9, "error_or_login_page"),
    ("Access denied", "Access denied " + BODY, 3, "article"),
    ("A title", "A title", 3, "no_extractable_text"),
    ("Supporting Information for\nthe paper", BODY, 9, "supplement"),
    ("Supporting Information for\nthe paper\nAbstract", BODY, 9, "supplement_suspect"),
    ("Supporting Information for\nthe paper\nAbstract", BODY + "References", 9, "article"),
    ("Corrigendum to a paper", BODY, 4, "corrigendum_or_erratum"),
    ("Corrigendum to a paper", BODY, 5, "article"),
    ("Corrigendum to a paper. Abstract", BODY + "References", 4, "article"),
    ("Table of contents", BODY, 6, "table_of_contents"),
    ("Table of contents", BODY, 7, "article"),
    ("Editorial: rivers", BODY + "References", 8, "editorial"),
    ("A word before editorial words", BODY, 4, "editorial"),
    ("A word before editorial words", BODY + "References", 4, "article"),
    ("Editorially written", BODY, 4, "article"),
    ("A title\nAbstract", BODY, 2, "abstract_only"),
    ("A title\nAbstract", BODY, 3, "article"),
    (None, None, None, "no_extractable_text"),
])
def test_document_type(spark, first, whole, pages, kind):
    rows = spark.createDataFrame([(first, whole, pages, len(whole or ""))], "f string, w string, p int, n int")
    rows = rows.select("p", I.evidence(F.col("f"), F.col("w"), F.lit(""), F.col("n")).alias("e"))
    assert rows.select(I.document_type(F.col("e.shown"), F.col("p"))).first()[0] == kind


def test_evidence(spark):
    """Other figures count as far as they are more than a supplement's own: the rule takes own ones off all numbers found."""
    text = "Figure S1. Fig. S2, Table S3; Scheme S4 Eq. S5 and Figure 6. Associated content. References"
    e = spark.createDataFrame([(text,)], "t string").select(I.evidence(F.col("t"), F.col("t"), F.lit("Erratum"), F.length("t")).alias("e")).first().e
    assert e.signals == ["almost_no_text", "corrigendum:erratum", "si_figure_dominant:5/5"]
    assert set(e.shown) == {"almost_no_text", "corrigendum", "si_figure_dominant", "brief", "references", "associated_content"}


TITLE = "Removal of dyes by iron minerals"


@pytest.mark.parametrize(("meta", "page", "authors", "how"), [
    ("Jane Roe", f"{TITLE}\nAnn Lee, John Smith", "Jane Roe", "metadata"),
    ("paper.pdf", f"{TITLE}\nAnn Lee, John Smith", "Ann Lee, John Smith", "layout"),
    (None, f"Ann Lee, John Smith\n{TITLE}\nWei Zhang and Jo Doe", "Wei Zhang and Jo Doe", "layout"),
    (None, f"{TITLE}\nUniversity of Rivers, Lake Town\nAnn Lee, John Smith", "Ann Lee, John Smith", "layout"),
    (None, f"{TITLE}\nAbstract\nAnn Lee, John Smith", "", "none"),
    (None, f"{TITLE}\nAbstract\n{TITLE}\nAnn Lee, John Smith", "Ann Lee, John Smith", "layout"),
    (None, "\n".join([TITLE, *["lower words"] * 13, "Ann Lee, John Smith"]), "Ann Lee, John Smith", "layout"),
    (None, "\n".join([TITLE, *["lower words"] * 14, "Ann Lee, John Smith"]), "", "none"),
    (None, "\n".join(["lower words"] * 40 + [TITLE, "Ann Lee, John Smith"]), "", "none"),
    (None, None, "", "none"),
])
def test_authors(spark, meta, page, authors, how):
    rows = spark.createDataFrame([(meta, page)], "m string, p string")
    assert tuple(rows.select(I.authors_of(F.col("m"), F.col("p"), F.lit(TITLE)).alias("a")).first().a) == (authors, how)


@pytest.mark.parametrize(("field", "page", "journal"), [
    (" Water  Research ", "Chemosphere", "Water Research"), ("10.1016/x", "In Chemosphere 3", "Chemosphere"), ("abc", "x DESALINATION y Water Research", "Water Research"),
    (None, "journal homepage: www.elsevier.com/x y", "journal homepage: www.elsevier.com/x"), (None, None, ""),
])
def test_journal(spark, field, page, journal):
    rows = spark.createDataFrame([(field, page)], "f string, p string")
    assert rows.select(I.journal_of([F.col("f")], F.col("p"))).first()[0] == journal


def test_markup_signals(spark):
    full = "<full-text-retrieval-response><dc:title>Iron</dc:title><ce:abstract/><ce:sections><ce:para>a</ce:para><ce:para>b</ce:para>"
    got = spark.createDataFrame([(full,), ("<dc:title>" + "y" * 99,), ("",), (None,)], "p string").select(Y.markup_signals(F.col("p")).alias("s")).collect()
    assert [tuple(r.s) for r in got] == [(True, 2, True, False, "Iron"), (False, 0, False, True, "y" * 80), (False, 0, False, True, ""), (False, 0, False, True, "")]


def test_json_signals(spark):
    core = {"dc:title": "T" * 90, "dc:description": "d", "openaccess": "0", "entitlement": 1, "x": 2}
    article = {"full-text-retrieval-response": {"coredata": core, "originalText": "<ce:sections><ce:para>"}}
    rows = [(json.dumps(article),), (json.dumps({"abstracts-retrieval-response": {"coredata": core}}),), ("{}",), ("no json",), (None,)]
    got = [tuple(r.s) for r in spark.createDataFrame(rows, "p string").select(Y.json_signals(F.col("p")).alias("s")).collect()]
    fields = ["openaccess", "entitlement"]
    assert got[0] == ("article", "T" * 80, True, "0", fields, 22, True, 1)
    assert got[1] == ("abstract", "T" * 80, True, "0", fields, None, None, None)
    assert got[2] == ("abstract", "", False, None, [], None, None, None)
    assert got[3] == got[4] == (None, "", False, None, [], None, None, None)


def test_split_checks(spark):
    rows = [("dev", "a"), ("dev", "a"), ("dev", "b"), ("dev", None), ("test", "a"), ("test", "a"), ("test", "a"), ("test", "c"), ("test", None)]
    got = M.split_checks(spark.createDataFrame(rows, "split string, key string"), "dev", "test").orderBy("split").collect()
    assert [tuple(r) for r in got] == [("dev", 4, 2, 6), ("test", 5, 2, 6)]
    assert M.split_checks(spark.createDataFrame([], "split string, key string"), "dev", "test").count() == 0


def test_by_action(spark):
    rows = [("A", "answer", "answer"), ("A", "answer", "answer"), ("A", "refuse", "answer"), ("N", "refuse", "refuse")]
    got = M.by_action(spark.createDataFrame(rows, "class string, expected string, predicted string")).orderBy("class").collect()
    assert [tuple(r) for r in got] == [("A", "answer", 3, 0.6667), ("N", "refuse", 1, 1.0)]


def test_block_bar(spark):
    got = spark.createDataFrame([(0,), (2,), (5,), (7,), (-1,), (None,)], "s int").select(block_bar(F.col("s"))).collect()
    assert [r[0] for r in got] == ["░░░░░", "██░░░", "█████", "█████", "░░░░░", ""]


def test_first_tokens(spark):
    rows = [("x", 1, False), ("x", 2, True), ("x", 3, True), ("y", 4, False), ("z", 5, None)]
    got = W.first_tokens(spark.createDataFrame(rows, "trace_id string, seq int, token boolean")).orderBy("trace_id").collect()
    assert [tuple(r) for r in got] == [("x", 2, 3), ("y", None, 4), ("z", None, 5)]


def made(column, rows):
    """The plan of a column, as text without cuts."""
    conf = rows.sparkSession.conf
    conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return rows.select(column.alias("x"))._jdf.queryExecution().analyzed().toString()
    finally:
        conf.unset("spark.sql.debug.maxToStringFields")


def test_lines_and_probes_are_made_once(spark):
    """A line is judged in one place, and the text that phrases are looked for in is made in one: inlined ones are made again for every use."""
    rows = spark.createDataFrame([("a", 1)], "f string, n int")
    f = F.col("f")
    assert made(I.text_title(f), rows).count("contents lists available") == 1
    assert made(I.evidence(f, f, F.lit("t"), F.col("n")), rows).count("4000)") == 1


def test_authors_are_sought_as_far_as_they_can_be(spark):
    rows = spark.createDataFrame([("a",)], "f string")
    plan = made(I.authors_of(F.lit(""), F.col("f"), F.lit(TITLE)), rows)
    assert plan.count("contents lists available") == plan.count("^\\s*(abstract") == 1
    assert "54" in plan  # forty lines that can repeat the title, fourteen behind the last of them
    assert made(I.journal_of([F.lit("")], F.col("f")), rows).count("lower(") == 1


def test_titles_by_hand(spark):
    """The first run of usable lines, cut once it's long enough, over pages of all kinds of lines."""
    r = random.Random(7)
    kinds = ["Water Research", "www.x.com", "Abstract", "short", "", " \t ", "A line of a title that goes on", "and  another\tline of it", "of a long title that ends here with a stop.",
             "Ann Lee, John Smith", "School of Rivers at the lake", "n" * 301, "Nature of rivers and of lakes", "journal homepage: x"]
    pages = ["\n".join(r.choice(kinds) for _ in range(r.randint(0, 40))) for _ in range(300)] + [None, "\n" * 50 + kinds[6]]
    bad = re.compile("|".join(f"(?:{x})" for x in ("Water Research", r"www\.", "^Abstract$", "Ann Lee", "School", "^n+$", "^Nature ", "journal homepage")))

    def by_hand(page):
        lines = [x for x in (re.sub(r"\s+", " ", y).strip() for y in (page or "")[:3000].split("\n")) if x][:30]
        run = []
        for x in lines:
            if 12 <= len(x) <= 300 and not bad.search(x):
                run.append(x)
                if len(" ".join(run)) > 60 and (x.endswith(".") or len(run) >= 3):
                    break
            elif run:
                break
        t = " ".join(run).strip(" .,;:-–—")
        return t if len(t) > 15 else ""

    rows = spark.createDataFrame([(p,) for p in pages], "p string")
    assert [x.t for x in rows.select(I.text_title(F.col("p")).alias("t")).collect()] == [by_hand(p) for p in pages]


def test_authors_behind_repeated_titles(spark):
    """A line counts as the title's only if all of it is inside, though it's first looked for by its start."""
    whole = "Removal of dyes by iron minerals in the light of rivers and lakes"
    page = "\n".join([whole[:40], "Ann Lee, John Smith", whole[:26] + " elsewhere", "Wei Zhang and Jo Doe", "the ＬＩＧＨＴ of rivers and ﬁlakes", "the ＬＩＧＨＴ of rivers", "Jo Roe and Al Poe"])
    rows = spark.createDataFrame([(page,)], "p string")
    assert rows.select(I.authors_of(F.lit(None).cast("string"), F.col("p"), F.lit(whole)).alias("a")).first().a.authors == "Jo Roe and Al Poe"
