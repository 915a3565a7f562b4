"""Fixed expectations of single rules."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import routing as G
from lectern.operators import chunking as K
from lectern.operators import corpus as C
from lectern.operators import metrics as M
from lectern.operators import monitor as W
from lectern.operators import retrieval as R

HEADINGS = [
    ("Abstract:", "abstract"), ("Materials and Methods", "methods"), ("1. Introduction", "introduction"), ("3.1 Adsorption experiments", "adsorption experiments"), ("REFERENCES", "references"),
    ("Results & Discussion", "results"), ("4.2 The effect of pH", "the effect of ph"), ("The results were good and we show them.", None), ("1. Smith, J. A. et al. (2020) Water", None), ("doi: 10.1/x", None), ("3.14 is just a number", None), ("", None), (None, None),
]


def test_headings(spark):
    rows = spark.createDataFrame(list(enumerate(x for x, _ in HEADINGS)), "i int, line string")
    found = {r.i: r.full for r in K.with_headings(rows).collect()}
    assert [found[i] for i in range(len(HEADINGS))] == [y for _, y in HEADINGS]


def test_fixed_chunks_keep_the_overlap_tail(spark):
    pages = spark.createDataFrame([("p", "p.pdf", 7, "x" * 120)], "paper_id string, source string, page int, text string")
    rows = K.cut_fixed(pages, 50, 0).orderBy("chunk_index").collect()
    assert [(r.chunk_id, len(r.text)) for r in rows] == [("p_p7_c0", 50), ("p_p7_c1", 50), ("p_p7_c2", 20)]
    assert [len(r.text) for r in K.cut_fixed(pages, 100, 80).orderBy("chunk_index").collect()] == [100, 100, 80, 60, 40, 20]
    with pytest.raises(ValueError):
        K.cut_fixed(pages, 10, 10)


def test_section_chunks(spark):
    pages = [("a", "a", 1, "Abstract\nfirst words"), ("a", "a", 2, "go on here\n1. Introduction\nintro text\nReferences\n1. Introduction\nlast"), ("b", "b", 1, "no heading"), ("b", "b", 2, "at all")]
    df = spark.createDataFrame(pages, "paper_id string, source string, page int, text string")
    rows = {r.chunk_id: r for r in K.build_chunks(df, size=200, overlap=0, least=1).collect()}
    assert rows["a__abstract__p1-2__i0"].text == "first words\ngo on here"
    assert rows["a__introduction__p2-2__i1"].text == "intro text"
    # behind the references heading numbered lines are no headings, but a bare section name still would be
    assert rows["a__references__p2-2__i2"].text == "1. Introduction last"
    assert rows["b__body__p1-2__i0"].chunking_mode == "fallback_fixed" and len(rows) == 4


def test_fusion(spark):
    dense = spark.createDataFrame([(1, "a1", 0.1, 0), (1, "a2", 0.2, 1)], "query_id int, id string, distance double, rank int")
    sparse = spark.createDataFrame([(1, "b1", 3.0, 0), (1, "a1", 2.0, 1)], "query_id int, id string, sparse_score double, rank int")
    rows = R.inherit_distance(R.rrf(dense, sparse)).orderBy("rank").collect()
    assert [r.id for r in rows] == ["a1", "b1", "a2"]
    assert rows[0].rrf_score == pytest.approx(1 / 61 + 1 / 62) and rows[1].distance == 0.1


def test_lexical_scores(spark):
    index = spark.createDataFrame([("x", "A", 0.5), ("x", "B", 0.2), ("y", "A", 0.3)], "token string, id string, weight double")
    asked = spark.createDataFrame([(1, "x", 1.0), (1, "y", 1.0)], "query_id int, token string, weight double")
    assert [(r.id, r.sparse_score) for r in R.sparse_search(asked, index).orderBy("rank").collect()] == [("A", 0.8), ("B", 0.2)]


def test_diversify_and_budget(spark):
    text = "the same words in both chunks"
    rows = [(1, 0, "c1", "s", 1, 1, text), (1, 1, "c2", "s", 1, 2, text), (1, 2, "c3", "s", 1, 9, text), (1, 3, "c4", "s", 1, 4, "other"), (1, 4, "c5", "t", 1, 2, "x" * 4000), (1, 5, "c6", "u", 1, 2, "short")]
    hits = spark.createDataFrame(rows, "query_id int, rank int, id string, source string, page int, chunk_index int, text string")
    kept = R.diversify(hits)
    assert [r.id for r in kept.orderBy("rank").collect()] == ["c1", "c3", "c5", "c6"]
    assert [r.id for r in R.within_budget(kept, 100).orderBy("rank").collect()] == ["c1", "c3", "c6"]


ROUTES = [
    ("What is the adsorption capacity of activated carbon for copper?", ["capacity of 46.3 mg/g; adsorption capacity 46.3 mg/g"], 0.3, "answer"), ("anything", [], 999.0, "refuse"), ("anything", ["x"], 1.2, "refuse"),
    ("哪种最好", ["膜"], 0.3, "clarify"), ("这个方法效果如何", ["膜"], 0.3, "clarify"), ("所有膜工艺的完整成本对比", ["膜"], 0.3, "partial_answer"), ("最佳 pH 是不是 10", ["optimum pH of 6.9"], 0.3, "correct_premise"),
    ("最佳 pH 是多少", ["pH was varied"], 0.3, "refuse"), ("电絮凝的最佳 pH 是多少", ["optimum pH of 6.9"], 0.3, "answer"),
]


def test_routes(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(ROUTES)], "i int, q string, t array<string>, d double")
    status = G.evidence_status(F.col("q"), F.col("t"), F.col("d"))
    found = {r.i: r.a for r in df.select("i", G.action(F.col("q"), F.col("t"), status, F.col("d"))["action"].alias("a")).collect()}
    assert [found[i] for i in range(len(ROUTES))] == [r[3] for r in ROUTES]


def test_citations(spark):
    rows = [(0, "结论 [S9]，见第 99 页。"), (1, "研究表明该方法有效。另有证据 [S1]。"), (2, "fine [s1], page 2"), (3, "没有足够证据"), (4, "Smith et al. found it [S1]")]
    df = spark.createDataFrame(rows, "i int, a string").select("i", G.validated(F.col("a"), F.lit(1), F.array(F.lit(2))).alias("v"))
    v = {r.i: r.v for r in df.collect()}
    assert v[0].status == "failed" and v[0].invalid == [9] and v[0].answer == "结论 ，见[页码无法核验]。" and v[0].unsupported_pages == [99]
    assert v[1].removed_claims == 1 and v[1].answer == "另有证据 [S1]。" and v[1].status == "corrected"
    assert [v[i].status for i in (2, 3, 4)] == ["passed", "passed", "failed"] and v[2].used == [1]


def test_run_summary(spark):
    judge = "struct<correctness int, evidence_relevance int, faithfulness int, completeness int, citation int, overall int, error_type string>".replace(" int", ": int").replace(" string", ": string")
    rows = [("a", (5, 0, 5, 5, 5, 5, "none"), None), ("b", (0, 4, 3, 3, 3, 3, "incomplete_answer"), None), ("c", None, "boom")]
    r = M.run_summary(spark.createDataFrame(rows, f"qid string, judge {judge}, error string")).first()
    assert (r.n, r.n_judged, r.n_errored, r.n_bad, r.avg_overall, r.avg_correctness, r.avg_evidence_relevance) == (3, 2, 1, 1, 4.0, 5.0, 4.0)


def test_watchdog(spark):
    def run(latencies, **last):
        base = [(1, i, float(i * 30), "dense", x, i, 50, 1, 100, 10.0) for i, x in enumerate(latencies)]
        rows = [list(r) for r in base]
        for k, v in last.items():
            for r in rows[-5:]:
                r[["pid", "seq", "ts", "stage", "latency", "progress", "gpu", "gpu_used", "gpu_total", "cpu"].index(k)] = v
        df = spark.createDataFrame([tuple(r) for r in rows], "pid int, seq int, ts double, stage string, latency double, progress int, gpu int, gpu_used int, gpu_total int, cpu double")
        return W.watchdog(df).orderBy(F.desc("seq")).first().status

    assert run([1.0] * 10 + [1.1]) == "running"
    assert run([1.0] * 10 + [2.5]) == "warning"
    assert run([1.0] * 10 + [5.0, 5.0, 5.0]) == "error"
    assert run([1.0] * 10 + [6.0]) == "warning"
    assert run([None] * 3 + [99.0]) == "running"
    assert run([1.0] * 30, gpu=5) == "warning"
    assert run([1.0] * 30, cpu=99.0) == "warning"


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60) if i % 13] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(30)]
    links = [x for x in links if x[0] != x[1]]
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.id: r.root for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == root


def test_near_pairs(spark):
    body = " ".join(f"word{i}" for i in range(300))
    rows = [(1, body), (2, body + " tail"), (3, body.upper()), (4, "something else entirely " * 20), (5, None)]
    assert [(r.a, r.b) for r in C.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [(1, 2)]


def test_quota_respects_caps(spark):
    rows = [(i, "t", f"a{i % 3}", f"j{i % 2}", 2000 + i % 26, i % 5 == 0, "A" if i % 2 else "B", float(1000 - i)) for i in range(100)]
    got = C.quota_selection(spark.createDataFrame(rows, "id long, topic string, author string, journal string, year int, review boolean, level string, score double"), 20).collect()
    assert len(got) == 9  # three authors, three papers each
    assert len({r.id for r in got}) == 9


def test_duplicate_roots_of_all_members(spark):
    """Copies, short copies, texts with equal grams and near copies have one root; documents without a link their own."""
    long = " ".join(f"word{i}" for i in range(200))
    rows = [(9, long), (2, long.upper() + "!"), (5, long + " z"), (1, long.replace("word150", "xxxx150")), (4, "Short."), (3, "short"), (8, "other"), (7, ""), (10, None)]
    got = C.duplicate_roots(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.root) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 1), (7, 7), (8, 8), (9, 1), (10, 10)]


def test_best_titles(spark):
    """Against all pairs: random titles, copies, a title of one word, one without words."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdefghijklm", k=rng.choice([1, 2, 4, 5, 9])))) for i in range(120)] + [(120, "A-b c"), (121, "c b a"), (122, "?"), (123, "zz"), (124, "yy xx"), (125, "xx q r"), (126, None)]
    sets = {i: {w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()} for i, t in rows}
    expected = []
    for i, s in sets.items():
        best = max(((len(s & o) / len(s | o), -j) for j, o in sets.items() if j != i and s & o), default=(0.0, None))
        expected.append((i, None if best[1] is None else -best[1], round(best[0], 6), best[0] >= 0.8, best[0] >= 0.9))
    got = C.best_titles(spark.createDataFrame(rows, "id long, title string")).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == expected
