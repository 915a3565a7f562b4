"""Rules of the corpus: first pages, dedup in stages, selection, spans and the sinks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.functions import inventory as I
from lectern.operators import acquisition as Q
from lectern.operators import corpus as C
from lectern.operators import dedup as D
from lectern.operators import spans as S
from lectern.sources import files
from lectern.sources import reports as O
from lectern.sources.places import fresh_place
from lectern.sources.tables import runs
from lectern.streaming.monitor import marker_stream, shown, status_sink


@pytest.mark.parametrize(("text", "year", "how"), [
    ("© 2019 Elsevier, published 3 May 2018", 2019, "copyright"), ("Copyright © 2021 by", 2021, "copyright"), ("published 3 May 2018", 2018, "first_page_max"),
    ("Published online: March 2021; in 2030", 2021, "published"), ("Received May 2015; accepted in June 2016", 2016, "accepted"), ("received in 2015", 2015, "received"),
    ("Water 2004, vol. 3 of 2010", 2004, "citation"), ("in 1998 and 2004, or 1959 and 2050", 2004, "first_page_max"), ("none", None, "none"), (None, None, "none"), ("x" * 6001 + " 2004", None, "none"),
])
def test_year(spark, text, year, how):
    row = spark.createDataFrame([(text,)], "t string").select(I.year_of(F.col("t")).alias("y")).first().y
    assert (row.year, row.how) == (year, how)


@pytest.mark.parametrize(("raw", "title"), [
    ("Removal of PFAS by adsorption", "Removal of PFAS by adsorption"), ("untitled", ""), ("Microsoft Word", ""), ("main_text_v2_final.docx", ""), ("PII: 0043-1354(95)00012", ""),
    ("12.34 - 56_78 90 11 12 13", ""), ("Supercalifragilistic", ""), ("short one", ""), (None, ""), ("  two \n lines of   a title ", "two lines of a title"),
])
def test_meta_title(spark, raw, title):
    assert spark.createDataFrame([(raw,)], "t string").select(I.meta_title(F.col("t"))).first()[0] == title


def test_thesis_title(spark):
    rows = [("论文题目：河流沉积物中微塑料的分布特征\n作者姓名", []), ("某大学\n长江中下游湖泊水体抗生素污染\n短行", []), ("no chinese", []), (None, [])]
    rows = [(a, [a] if a and "题目" in a else b) for a, b in rows]
    got = spark.createDataFrame(rows, "f string, p array<string>").select(I.thesis_title(F.col("f"), F.col("p"))).collect()
    assert [r[0] for r in got] == ["河流沉积物中微塑料的分布特征", "长江中下游湖泊水体抗生素污染", "", ""]


RECORD = "id long, source_group string, doc_type string, open_error string, sha256 string, images_only boolean, doi string, title string, text string, has_references boolean, file_name string"


def record(i, text, doi="", title="A title of sufficient length", sha=None, group="g", kind="article", refs=False, error="", images=False):
    return (i, group, kind, error, sha or f"s{i}", images, doi, title, text, refs, f"f{i}.pdf")


def test_staged_dedup(spark):
    rng = random.Random(3)
    words = lambda n, seed: " ".join(random.Random(seed).choice(["river", "stone", "water", "cloud", "grass", "metal"]) + str(random.Random(seed * 7 + k).randrange(999)) for k in range(n))
    a, b, c = words(300, 1), words(300, 2), words(300, 3)
    rows = [
        record(1, a, sha="same"), record(2, a, sha="same", doi="10.1/a"), record(3, b, doi="10.1/b"), record(4, b + " tail", doi="10.1/b", refs=True),
        record(5, c), record(6, c + " and a closing word"), record(7, c + " other end", title="Something else entirely here"), record(8, "short"), record(9, words(300, 9), group=D.PRIOR),
        record(10, words(300, 10), kind="editorial"), record(11, words(300, 11), error="broken"), record(12, words(300, 12), images=True), record(13, None), record(14, words(300, 14)),
        record(15, b + " third", doi="10.1/other"),
    ]
    rng.shuffle(rows)
    got = {r.id: (r.disposition, r.survivor, r.resolution) for r in D.staged(spark.createDataFrame(rows, RECORD)).collect()}
    assert got[1] == ("sha256", 2, "") and got[2] == ("kept", None, "unique_doi")
    assert got[3] == ("doi", 4, "") and got[4] == ("kept", None, "unique_doi")
    assert got[5] == ("title_text", 6, "") and got[6] == ("kept", None, "unique_title_text")
    assert got[7] == ("kept", None, "unresolved") and got[14] == ("kept", None, "unresolved") and got[15] == ("kept", None, "unique_doi")
    assert all(got[i][0] == "rejected" for i in (8, 9, 10, 11, 12, 13))
    account = D.accounting(spark.createDataFrame([(i, d, r) for i, (d, _, r) in got.items()], "id long, disposition string, resolution string")).first()
    assert account.total == account.rejected + account.sha_dup + account.doi_dup + account.titletext_dup + account.final == 15


def test_gram_pairs_equal_all_pairs(spark):
    rng = random.Random(5)
    base = [f"g{i}" for i in range(40)]
    sets = []
    for i in range(60):
        s = set(base if i % 3 else [f"h{j}" for j in range(30)])
        for x in rng.sample(sorted(s), rng.randrange(6)):
            s.discard(x)
            if rng.random() < 0.5:
                s.add(f"n{rng.randrange(50)}")
        sets.append((i, sorted(s)))
    want = {(i, j) for i, a in sets for j, b in sets if i < j and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.85}
    got = {(r.a, r.b) for r in C.gram_pairs(spark.createDataFrame(sets, "id long, grams array<string>")).collect()}
    assert got == want and len(want) > 100


def test_unique_names(spark):
    rows = [(1, "x", "A.pdf"), (2, "x", "a.PDF"), (3, "x", "A.pdf"), (4, "y", "A.pdf"), (5, "x", "a_2.pdf"), (6, "x", None), (7, "x", 'b<>:".txt')]
    got = [r.file for r in D.unique_names(spark.createDataFrame(rows, "id long, folder string, file_name string")).orderBy("id").collect()]
    assert got[0] == "A.pdf" and got[3] == "A.pdf" and got[5] == "unnamed.pdf" and got[6] == "b____.txt"
    assert len({(f, n.lower()) for (_, f, _), n in zip(rows, got)}) == len(rows)


def test_trim_selection(spark):
    rng = random.Random(9)
    rows = [(i, f"t{i % 3}", f"a{rng.randrange(8)}", f"j{rng.randrange(4)}", rng.randrange(2005, 2026), rng.random() < 0.4, round(rng.random(), 3)) for i in range(200)]
    quota, want = 15, set()
    for t in ("t0", "t1", "t2"):
        pool = sorted((r for r in rows if r[1] == t), key=lambda r: (-r[6], r[0]))
        picked, authors, journals = [], Counter(), Counter()

        def ok(r):
            reviews = sum(x[5] for x in picked)
            return authors[r[2]] < C.PER_AUTHOR and journals[r[3]] < C.PER_JOURNAL and not (r[5] and reviews >= max(2, round(quota * C.REVIEW_SHARE)))

        for r in pool:
            if sum(x[4] >= 2020 for x in picked) < max(2, round(quota * C.RECENT_SHARE)) and r[4] >= 2020 and ok(r):
                picked.append(r)
                authors[r[2]] += 1
                journals[r[3]] += 1
        for r in pool:
            if len(picked) < quota and r not in picked and ok(r):
                picked.append(r)
                authors[r[2]] += 1
                journals[r[3]] += 1
        want |= {r[0] for r in picked}
    table = spark.createDataFrame(rows, "id long, topic string, author string, journal string, year int, review boolean, score double")
    assert {r.id for r in C.trim_selection(table, quota).collect()} == want


def test_numbered(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    got = C.numbered(rows, [F.desc("k")]).collect()
    assert sorted((r.n, r.k) for r in got) == [(i + 1, 4999 - i) for i in range(5000)]


def test_spans_of_any_length(spark):
    chunks = spark.createDataFrame([(1, "Alpha  beta\ngamma delta epsilon zeta"), (2, "xalpha beta gamma delta epsilonx"), (3, None)], "id long, text string")
    golds = ["alpha beta gamma delta epsilon", "beta gamma delta", "amma", "pha be", "nowhere to be found at all", "", None, "BETA GAMMA"]
    cases = spark.createDataFrame(list(enumerate(golds)), "case_id int, gold string")
    got = {}
    for r in S.holding(cases, chunks).collect():
        got.setdefault(r.case_id, set()).add(r.id)
    assert got == {0: {1, 2}, 1: {1, 2}, 2: {1, 2}, 3: {1, 2}, 7: {1, 2}}


def test_spans_need_no_nested_loop(spark):
    chunks = spark.createDataFrame([(1, "a b c d e f g")], "id long, text string")
    cases = spark.createDataFrame([(1, "b c d e f")], "case_id int, gold string")
    plan = S.holding(cases.filter("length(gold) > 5"), chunks)._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan or "SortMergeJoin" in plan


def test_locations_and_routes(spark):
    spots = "array<struct<version: string, url: string>>"
    rows = [([("submittedVersion", "a"), ("publishedVersion", None), ("acceptedVersion", "b")],), ([],), (None,), ([(None, "z"), ("publishedVersion", "p")],)]
    got = spark.createDataFrame(rows, f"l {spots}").select(Q.best_location(F.col("l"))).collect()
    assert [r[0] for r in got] == ["b", None, None, "p"]
    assert [r[0] for r in spark.createDataFrame([("score=1.25; x",), ("score=x",), (None,), ("a",)], "n string").select(Q.noted_score(F.col("n"))).collect()] == [1.25, 0, 0, 0]


def test_run_files_round_trip(spark):
    judge = {"correctness": 4, "faithfulness": 5, "completeness": 3, "citation": 2, "evidence_relevance": 0, "overall": 3, "error_type": "none", "reason": "r"}
    kind = "correctness: int, faithfulness: int, completeness: int, citation: int, evidence_relevance: int, overall: int, error_type: string, reason: string"
    schema = f"run_id string, timestamp string, results array<struct<qid: string, question: string, model_answer: string, judge: struct<{kind}>, error: string>>"
    run = spark.createDataFrame([("r1", "2026", [("q1", "why", "so", tuple(judge.values()), None)])], schema)
    path = fresh_place(spark, "runs")
    O.save_run(run, path)
    assert runs(spark, path).collect() == run.collect()
    with pytest.raises(Exception, match="already exists"):
        O.save_run(run, path)


def test_reports_of_dedup(spark):
    rows = spark.createDataFrame([record(1, "x" * 300, doi="10.1/a"), record(2, "x" * 300, doi="10.1/a", refs=True), record(3, "y")], RECORD)
    path = fresh_place(spark, "reports")
    O.write_reports(O.dedup_reports(rows, D.staged(rows)), path)
    read = lambda name: spark.read.option("header", True).csv(f"{path}/{name}").collect()
    assert [r.id for r in read("manifest")] == ["2"] and [(r.id, r.survivor, r.dup_kind) for r in read("duplicates")] == [("1", "2", "doi")]
    assert [r.id for r in read("rejected")] == ["3"] and read("unresolved") == []


def test_marker_filter_by_token():
    said, held = [], ""
    for token in ["see ", "[", "S1", "2] and", " [not] [s", "3][S4] ", "[open"]:
        out, held = shown(held, token)
        said.append(out)
    assert said == ["see ", "", "", " and", " [not] ", " ", ""] and held == "[open"


def test_marker_stream(spark):
    texts = {"a": "x [S1] y [S22][s3] z [no] [S", "b": "[S1]", "c": "plain"}
    rng = random.Random(2)
    rows = []
    for t, text in texts.items():
        cuts = sorted(rng.sample(range(1, len(text)), min(3, len(text) - 1)))
        parts = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])]
        rows += [(t, i, p, i == len(parts) - 1) for i, p in enumerate(parts)]
    place = fresh_place(spark, "tokens")
    schema = "trace_id string, seq long, token string, final boolean"
    spark.createDataFrame(rows, schema).write.parquet(place)
    stream = marker_stream(spark.readStream.schema(schema).parquet(place))
    query = stream.writeStream.format("memory").queryName("markers").trigger(availableNow=True).option("checkpointLocation", fresh_place(spark, "state")).start()
    query.awaitTermination()
    got = {}
    for r in sorted(spark.table("markers").collect(), key=lambda r: (r.trace_id, r.seq)):
        got[r.trace_id] = got.get(r.trace_id, "") + r.shown
    assert got == {"a": "x  y  z [no] [S", "b": "", "c": "plain"}


def test_status_sink(spark):
    """Two batches: all judged samples are logged, and the status folder of the last batch has each process once."""
    place = fresh_place(spark, "status")
    schema = "pid long, seq long, ts double, stage string, latency double, progress double, gpu int, gpu_used int, gpu_total int, cpu double"
    sample = lambda pid, seq, cpu=10.0: (pid, seq, float(seq), "s", 1.0, float(seq), 50, 1, 100, cpu)
    for rows in ([sample(1, 0), sample(2, 1)], [sample(1, i, 99.0) for i in range(2, 9)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{place}/in")
        source = spark.readStream.schema(schema).parquet(f"{place}/in")
        status_sink(source, f"{place}/log", f"{place}/status", f"{place}/checkpoint").awaitTermination()
    assert spark.read.json(f"{place}/log").count() == 9
    got = {r.pid: (r.seq, r.status) for r in spark.read.json(f"{place}/status/1").collect()}
    assert got == {1: (8, "warning"), 2: (1, "running")}


def test_sinks(spark):
    judge = "struct<correctness: int, evidence_relevance: int, faithfulness: int, completeness: int, citation: int, overall: int, error_type: string, reason: string>"
    rows = spark.createDataFrame(
        [("q1", "", "why, \"so\"", (1, 2, 3, 4, 5, 5, "none", "r"), [("a.pdf", 0.25)], None), ("q2", "x", "how", None, None, "timeout")],
        f"qid string, answer_type string, question string, judge {judge}, retrieved array<struct<source: string, distance: double>>, error string",
    )
    path = fresh_place(spark, "sinks")
    O.write_flat(rows, f"{path}/flat")
    back = {r.qid: r for r in spark.read.option("header", True).option("escape", '"').csv(f"{path}/flat").collect()}
    assert list(back["q1"].asDict()) == list(O.FLAT) and back["q1"].top1_distance == "0.2500" and (back["q2"].overall, back["q2"].has_error) == (None, "1")
    O.write_pages(O.result_sections(rows), f"{path}/pages")
    text = "".join(r.value for r in spark.read.text(f"{path}/pages", wholetext=True).collect())
    assert "## q1" in text and "| correctness | █░░░░ 1 |" in text and "_未评测_" in text
    chunks = spark.createDataFrame([("p", "methods", 1, "body")], "paper_id string, section string, page_start int, text string")
    O.write_chunks(chunks, f"{path}/chunks")
    assert spark.read.schema(chunks.schema).json(f"{path}/chunks").collect() == chunks.collect()
    with pytest.raises(Exception, match="already exists"):
        O.write_chunks(chunks, f"{path}/chunks")


def test_pages_for_modes(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one  two\nthree " * 9 + b"\fshort")
    parse = lambda data: data.decode().split("\f")
    lines = files.pages_for(spark, str(tmp_path), parse, "section_aware").orderBy("page").collect()
    plain = files.pages_for(spark, str(tmp_path), parse, "fixed").collect()
    assert [r.page for r in lines] == [1, 2] and "\n" in lines[0].text and [r.page for r in plain] == [1] and "\n" not in plain[0].text
