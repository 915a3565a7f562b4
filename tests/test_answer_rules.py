"""Evidence, contradiction and routing on single cases, with answers from the rules."""

from pyspark.sql import functions as F

from lectern.functions import routing as G
from lectern.functions import text as T
from lectern.operators import corpus as C
from lectern.operators import metrics as M

#: question, texts, best distance: status, metric, support, contradicted, false premise, action
CASES = [
    ("What is the adsorption capacity of activated carbon for copper?", ["The adsorption capacity of 46.3 mg/g was found."], 0.4, "available", "capacity", "supported", False, False, "answer"),
    ("What is anything at all?", [], 999.0, "insufficient", None, "unsupported", False, False, "refuse"),
    ("tell me about fluxes", ["far away text"], 1.3, "insufficient", None, "supported", False, False, "refuse"),
    ("哪种膜最好", ["膜通量高"], 0.5, "available", None, "partial", False, False, "clarify"),
    ("这个方法效果如何", ["吸附"], 0.5, "available", None, "supported", False, False, "clarify"),
    ("所有膜工艺的完整成本对比", ["成本 5 元"], 0.5, "available", None, "supported", False, False, "partial_answer"),
    ("最佳 pH 是不是 10", ["the optimum pH of 6.9 was used"], 0.5, "available", "pH", "supported", True, True, "correct_premise"),
    ("最佳 pH 是不是 10", ["acidic pH is best"], 0.5, "available", "pH", "unsupported", False, False, "refuse"),
    ("最佳 pH 是多少", ["pH matters in this work"], 0.5, "available", "pH", "unsupported", False, False, "refuse"),
    ("电絮凝的最佳 pH 是多少", ["optimum pH of 6.9"], 0.5, "available", "pH", "supported", False, False, "answer"),
    ("去除率是多少 mg", ["removal was high"], 0.5, "insufficient", "removal", "unsupported", False, False, "refuse"),
    ("does the study show 95 removal", ["removal rate of 90 %", "removal 95"], 0.3, "available", "removal", "supported", True, True, "correct_premise"),
    ("is it true that 12 samples were used", ["we used 14 samples"], 0.2, "available", None, "supported", True, True, "correct_premise"),
    ("is it correct that TiO2 is the most stable", ["TiO2 had the lowest stability"], 0.6, "available", None, "supported", False, True, "correct_premise"),
    ("which of these is the best", ["x"], 0.1, "available", None, "partial", False, False, "clarify"),
    ("give a comprehensive overview of dose", ["dose 5"], 0.1, "available", "dosage", "supported", False, False, "partial_answer"),
    ("what is the dosage", ["dosage" + "x" * 69 + "5"], 0.1, "available", "dosage", "supported", False, False, "answer"),
    ("what is the dosage", ["dosage" + "x" * 70 + "5"], 0.1, "available", "dosage", "unsupported", False, False, "refuse"),
    ("how much flux", [None, "5 L flux"], 0.9, "available", "flux", "supported", False, False, "answer"),
    ("reaction time 30 maximum", ["no number for the reaction time"], 0.6, "available", "time", "unsupported", False, False, "refuse"),
]


def test_routing(spark):
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, q string, x array<string>, d double")
    q, x, d = F.col("q"), F.col("x"), F.col("d")
    status = G.evidence_status(q, x, d)
    got = rows.select("i", status, G.metric_of(q), G.support(q, x)["status"], G.contradicted(q, x), G.false_premise(q, x), G.action(q, x, status, d)["action"])
    assert sorted(tuple(r) for r in got.collect()) == [(i, *c[3:]) for i, c in enumerate(CASES)]


def of(spark, values, rule):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.r for r in sorted(rows.select("i", rule(F.col("v")).alias("r")).collect(), key=lambda r: r.i)]


def test_packed_sources(spark):
    fields = ["[S1] a.pdf | page 2 | distance=0.4153 || [S2] b c.pdf | page 11 | distance=0.5", "", None, "junk || S3 x.pdf|page 4|distance=1", "[S1] a.pdf | page x | distance=0.1"]
    got = [[tuple(s) for s in r] for r in of(spark, fields, M.retrieved_sources)]
    assert got == [[("S1", "a.pdf", 2, 0.4153), ("S2", "b c.pdf", 11, 0.5)], [], [], [("S3", "x.pdf", 4, 1.0)], []]


def test_judgements(spark):
    texts = ['{"overall": 4, "error_type": "none"}', 'Sure: {"overall": 2, "error_type": "off_topic"} done', "no json", None, '{"overall": "x"}']
    assert [r and tuple(r) for r in of(spark, texts, M.judge_of)] == [(4, "none"), (2, "off_topic"), None, None, None]


def test_records_titles_and_identifiers(spark):
    works = ['{"authorships": [{"author": {"display_name": "A. B."}}], "host": {"name": "J"}}', '{"authorships": []}', "{}", None]
    assert [tuple(r) for r in of(spark, works, C.work_fields)] == [("A. B.", "J"), ("", ""), ("", ""), ("", "")]
    dois = ["https://doi.org/10.1016/J.Watres.2020.115", "doi: 10.1021/acs.est.0c01.,;", "DOI 10.5/x", " 10.1000/abc getrights", "10.1000/abchttp://x", "not a doi", None, "http://dx.doi.org/10.1/ABC)"]
    assert of(spark, dois, T.doi_normal) == ["10.1016/j.watres.2020.115", "10.1021/acs.est.0c01", "10.5/x", "10.1000/abc", "10.1000/abc", "", "", "10.1/abc"]


def test_first_pages(spark):
    authors = ["Smith J., Doe A.", "John Smith and Ann Lee", "", None, "Müller-Lüdenscheidt2, K."]
    assert of(spark, authors, T.first_author) == ["smith", "smith", "", "", "müller-lüdenscheidt"]
    pages = ["Contents. Abstract: We did it. Keywords: a, b", "no heading here", "A B S T R A C T\nText. 1. Introduction more", None]
    assert of(spark, pages, T.abstract_of) == ["We did it. ", "no heading here", "Text. ", ""]
