import json
import os
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import answering
from lectern.operators import chunking as K
from lectern.operators import dedup as D
from lectern.operators import monitor as W
from lectern.operators import retrieval as R
from lectern.plans import adapters, monitoring
from lectern.sources import files
from lectern.sources import tables as S
from lectern.sources.places import fresh_place
from lectern.streaming import monitor as stream

SF = "/root/testdata/sf0.001"


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿final_file,resolution,doi,title\nfoo.pdf,unique,10.1/x,Title One\n,x,,blank\n", encoding="utf-8")
    rows = {r.key: r.title for r in S.paper_meta(spark, str(tmp_path / "m.csv")).collect()}
    assert rows == {"foo.pdf": "Title One", "foo": "Title One"}
    assert S.paper_meta(spark, str(tmp_path / "absent.csv")).collect() == []


def test_json_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "1", "question": "q", "expected_sources": ["a"]}\nbroken\n')
    assert [r.id for r in S.json_lines(spark, str(tmp_path / "c.jsonl"), strict=False).collect()] == ["1"]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        S.json_lines(spark, str(tmp_path / "c.jsonl")).collect()


def test_runs(spark, tmp_path):
    run = {"run_id": "r1", "timestamp": "t", "results": [{"qid": "q1", "judge": {"overall": 4}}, {"qid": "q2", "error": "x"}]}
    (tmp_path / "a.json").write_text(json.dumps(run, indent=1))
    (tmp_path / "b.json").write_text("{ not json")
    rows = S.run_results(S.runs(spark, str(tmp_path))).orderBy("qid").collect()
    assert [(r.qid, r.judge.overall if r.judge else None, r.error) for r in rows] == [("q1", 4, None), ("q2", None, "x")]


def test_page_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.pdf").write_bytes(b"a  b " * 20 + b"\fshort")
    (tmp_path / "sub" / "bad.pdf").write_bytes(b"\xff\xff")
    rows = S.page_files(spark, str(tmp_path), lambda b: b.decode().split("\f")).collect()
    assert [(r.paper_id, r.page, r.text) for r in rows] == [("one", 1, ("a b " * 20).strip())]


def test_collection_and_index(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "one two two"), ("c2", "two three")], "chunk_id string, text string")
    path = str(tmp_path / "chunks")
    assert S.collection_count(spark, path) == 0
    S.write_collection(chunks, path)
    with pytest.raises(Exception, match="exist"):
        S.write_collection(chunks, path)
    assert S.collection_count(spark, path) == 2
    version = S.collection_version(chunks)
    assert version == S.collection_version(chunks.orderBy(F.desc("chunk_id")))
    S.save_index(R.sparse_index(chunks.withColumnRenamed("chunk_id", "id")), str(tmp_path / "index"), version, 2)
    assert S.load_index(spark, str(tmp_path / "index"), version, 2).count() == 4
    with pytest.raises(S.StaleIndex):
        S.load_index(spark, str(tmp_path / "index"), "other", 2)


def test_watchdog_stream_equals_batch(spark, tmp_path):
    rows = monitoring.samples(spark, SF).withColumns({"pid": F.col("pid").cast("long"), "ts": F.col("ts").cast("double")})
    for i, part in enumerate((rows.filter("seq < 400"), rows.filter("seq >= 400 and seq < 800"), rows.filter("seq >= 800"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream.watchdog_stream(source).writeStream.format("memory").queryName("watch").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    found = {(r.pid, r.seq): r.status for r in spark.table("watch").collect()}
    assert found == {(r.pid, r.seq): r.status for r in W.watchdog(rows).collect()}


def test_trace_sink(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2026-01-01 00:00:00' AS ts, id % 3 AS trace_id, id AS n FROM range(9)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    stream.trace_sink(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.trace_id for r in spark.read.json(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_discovery(spark, tmp_path):
    for name in ("a/x.pdf", "a/sub/y.pdf", "b/z.PDF", "b/z.pdf", "b/sub/w.pdf", "a/n.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    folders = {"deep": (str(tmp_path / "a"), True), "flat": (str(tmp_path / "b"), False), "again": (str(tmp_path / "a"), False), "none": (str(tmp_path / "c"), True)}
    got = {r.path.split("/", 1)[1].rsplit(str(tmp_path.name), 1)[-1]: r.source_group for r in files.discovered(spark, folders).collect()}
    assert got == {"/a/x.pdf": "deep", "/a/sub/y.pdf": "deep", "/b/z.pdf": "flat"}


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("in/a.pdf", b"A")
        z.writestr("b.PDF", b"B")
        z.writestr("c.txt", b"C")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = {(r.archive, r.name, bytes(r.content)) for r in files.zip_members(spark, str(tmp_path)).collect()}
    assert got == {("one.zip", "a.pdf", b"A"), ("one.zip", "b.PDF", b"B")}


def test_csv_pair_and_newest(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,question\n1,a\n2,b\n,c\n")
    (tmp_path / "j.csv").write_text("id,overall,error_type\n1,3,none\n1,5,off_topic\n ,1,none\n")
    got = {r.question: r.judge and tuple(r.judge) for r in files.csv_pair(spark, str(tmp_path / "e.csv"), str(tmp_path / "j.csv")).collect()}
    assert got == {"a": (5, "off_topic"), "b": None, "c": None}
    assert files.csv_pair(spark, str(tmp_path / "e.csv")).filter("judge is not null").count() == 0
    os.utime(tmp_path / "j.csv", (1, 1))
    assert files.newest(spark, str(tmp_path), {"id": "qid", "absent": "x"}).columns == ["qid", "question"]


def test_resumed(spark):
    """Stopped while a batch runs, and after its results were written: no row is lost or repeated, nulls and equal rows included."""
    rows = [(f"10.1/{i:02d}",) for i in range(45)] + [(None,), (None,), ("10.1/00",)]
    todo = spark.createDataFrame(rows, "doi string").coalesce(1)
    path = fresh_place(spark, "resumed")

    def work(batches):
        for b in batches:
            if (b["doi"] == "10.1/30").any() and not os.path.exists(flag):
                open(flag, "w").close()
                raise RuntimeError("stopped")
            yield b.assign(n=1)

    flag = f"/tmp/{uuid.uuid4().hex}"
    with pytest.raises(Exception, match="stopped"):
        files.resumed(todo, path, work, "doi string, n int", batch=2)
    before = files.results(spark, path, "doi string, n int").count()
    assert 0 < before < 48 and before % 2 == 0
    found = files.resumed(todo, path, work, "doi string, n int", batch=2)
    assert sorted((r.doi or "",) for r in found.collect()) == sorted((d or "",) for (d,) in rows)
    # a batch whose end wasn't recorded is repeated, and replaces what it wrote
    commits = f"{path.removeprefix('file://')}/checkpoint/commits"
    last = max(int(x) for x in os.listdir(commits) if x.isdigit())
    for x in (f"{commits}/{last}", f"{commits}/.{last}.crc"):
        os.remove(x)
    more = spark.createDataFrame([*rows, ("10.1/99",), (None,)], "doi string").coalesce(1)
    found = files.resumed(more, path, work, "doi string, n int", batch=2)
    assert sorted((r.doi or "",) for r in found.collect()) == sorted((d or "",) for (d,) in [*rows, ("10.1/99",), (None,)])
    assert files.remaining(todo, spark.createDataFrame([("10.1/00",)], "doi string")).count() == 46


def test_answers_in_steps(spark):
    cases = spark.createDataFrame([(f"q{i}", "bad" if i == 3 else "why") for i in range(9)], "qid string, question string")

    def answer(question):
        if question == "bad":
            raise ValueError("no")
        return question.upper()

    path = fresh_place(spark, "answers")
    for _ in range(2):
        rows = answering.answered_in_steps(cases, answer, path, batch=2).collect()
        assert sorted((r.qid, r.model_answer, r.error) for r in rows) == sorted((r.qid, r.model_answer, r.error) for r in answering.answered(cases, answer).collect())


def test_request_traces(spark, tmp_path):
    """Ends, errors, starts without end, ends without start, replays, over several batches."""
    minute = 60_000_000
    batches = [
        [("a", 0, "start", None), ("b", 0, "start", None), ("c", 1, "end", None), ("d", 1, "start", None), (None, 1, "start", None)],
        [("a", 2, "end", None), ("a", 3, "error", "again"), ("b", 2, "error", "broken"), ("b", 2, "start", None)],
        [("a", 4, "start", None), ("a", 4, "end", None), ("e", 5, "start", None), ("e", 5, "other", None), ("d", 12, "end", None)],
        [("x", 30, "clock", None)],
        [("a", 0, "start", None), ("y", 90, "clock", None)],
    ]
    for i, rows in enumerate(batches):
        table = spark.createDataFrame([(t, (m + 100) * minute, k, s) for t, m, k, s in rows], "trace_id string, us long, kind string, message string")
        table.select("trace_id", F.timestamp_micros("us").alias("ts"), "kind", "message").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = "trace_id string, ts timestamp, kind string, message string"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = stream.request_traces(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    back = lambda us: None if us is None else us - 100 * minute
    got = {(r.trace_id, back(r.started), back(r.ended), r.outcome, r.message) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        ("a", 0, 2 * minute, "ok", None), ("b", 0, 2 * minute, "error", "broken"), ("c", None, minute, "ok", None),
        ("d", minute, 11 * minute, "disconnect", None), ("e", 5 * minute, 15 * minute, "disconnect", None),
    }
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_runs_of_questions(spark):
    def answer(question):
        if question == "bad":
            raise ValueError("no model")
        return question.upper()

    rows = answering.answered(spark.createDataFrame([("q1", "why"), ("q2", "bad")], "qid string, question string"), answer).collect()
    assert [(r.model_answer, r.error) for r in sorted(rows)] == [("WHY", None), ("[ERROR] no model", "ValueError: no model")]
    kind = "qid string, question string, model_answer string, judge struct<overall: int, error_type: string>, error string"
    results = spark.createDataFrame([
        ("q1", "a", "x", (5, "none"), None), ("q2", "b", "y", None, "slow\n[JUDGE ERROR] Timeout: x"), ("q3", "c", "", None, "ValueError: x"), ("q4", "boom", "w", None, "[JUDGE ERROR] old"),
    ], kind)

    def judge(question, text):
        if question == "boom":
            raise RuntimeError("again")
        return 4, "none"

    got = {r.qid: (r.judge and tuple(r.judge), r.error) for r in answering.judged(results, judge).collect()}
    assert got == {"q1": ((5, "none"), None), "q2": ((4, "none"), "slow"), "q3": (None, "ValueError: x"), "q4": (None, "[JUDGE ERROR] RuntimeError: again")}


def test_unreadable_files_are_rows(spark, tmp_path):
    for name, content in (("a.pdf", b"one\ftwo"), ("bad.pdf", b"\xff\xff"), ("none.pdf", b"-")):
        (tmp_path / name).write_bytes(content)
    rows = S.read_pages(spark, str(tmp_path), lambda b: [x or None for x in b.decode().split("\f")] if b != b"-" else [])
    got = {(r.paper_id, r.page, r.text, (r.error or "").split(":")[0]) for r in rows.collect()}
    assert got == {("a", 1, "one", ""), ("a", 2, "two", ""), ("bad", None, None, "UnicodeDecodeError"), ("none", None, None, "no pages")}


def test_ingested_counts_while_writing(spark, tmp_path):
    pages = adapters.headed_pages(spark, SF)
    chunks = K.build_chunks(pages)
    expected = chunks.agg(F.count("*"), F.count_if(~K.indexable(F.col("section"))), F.count_if(F.col("chunking_mode") == "fallback_fixed")).first()
    got = S.ingested(pages, str(tmp_path / "chunks"))
    assert (got["pages"], got["chunks"], got["excluded"], got["fallbacks"]) == (pages.count(), *expected)
    assert got["indexed"] == spark.read.parquet(str(tmp_path / "chunks")).count() == got["chunks"] - got["excluded"] > 0
    fixed = S.ingested(A_pages(spark), str(tmp_path / "fixed"), "fixed", size=40, overlap=5)
    assert fixed["excluded"] == fixed["fallbacks"] == 0 < fixed["chunks"]


def A_pages(spark):
    return spark.createDataFrame([("p", "p.pdf", 1, "word " * 60)], "paper_id string, source string, page int, text string")


def test_files_in_folders(spark, tmp_path):
    """Kept, duplicate and rejected files in folders of theirs; a stopped run leaves nothing, the next one everything."""
    for i in range(9):
        (tmp_path / f"in/{i}").mkdir(parents=True)
        (tmp_path / f"in/{i}/paper.pdf").write_bytes(bytes([i]) * (3_000_000 if i == 4 else i))
    rows = [(i, f"file:{tmp_path}/in/{i}/paper.pdf", ("kept", "duplicates", "rejected")[i % 3], "paper.pdf") for i in range(9)]
    plan = spark.createDataFrame(rows, "id long, path string, folder string, file_name string")
    plan = D.unique_names(plan).join(plan.select("id", "path"), "id").select("path", "folder", "file")
    broken = plan.withColumn("path", F.when(F.col("path").contains("/7/"), "file:/none").otherwise(F.col("path")))
    with pytest.raises(Exception, match="none"):
        files.placed(broken, f"{tmp_path}/out")
    assert not (tmp_path / "out").exists()
    log = files.placed(plan, f"{tmp_path}/out").collect()
    got = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*.pdf")}
    assert {r.place: r.length for r in log} == {k: len(v) for k, v in got.items()} and len(got) == 9
    assert got["kept/paper.pdf"] == b"" and got["kept/paper_2.pdf"] == b"\x03" * 3 and got["duplicates/paper_2.pdf"] == b"\x04" * 3_000_000
    assert not [p for p in (tmp_path / "out").rglob(".*") if not p.name.endswith(".crc")]
    with pytest.raises(FileExistsError):
        files.placed(plan, f"{tmp_path}/out")
