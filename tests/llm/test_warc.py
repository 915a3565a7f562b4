import hashlib

import pytest

from lectern.llm import warc
from lectern.llm.shared import fresh_path


def trip(spark, pages):
    path = fresh_path(spark, "archives")
    warc.write_archives(pages, path)
    return path, warc.resolved_revisits(warc.read_archives(spark, path)).collect()


def brute(rows):
    best = {}
    for i, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and i is not None:
            best[b] = max(best.get(b, i), i)
    out = []
    for i, html in rows:
        b = (html or "").encode()
        o = best.get(b)
        revisit = o is not None and o != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", o if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    big = "é\r\n\r\nWARC/1.1 <html>\n" * 90
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, None), (4, "", "x" * 999), (5, "u", "x" * 999), (6, "u", "x" * 1000), (7, "u", "x" * 1000), (None, "n", big), (2, "http://b", big), (8, "z", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, payload_digest string, _block int")
    path, found = trip(spark, pages)
    assert sorted(map(tuple, found), key=repr) == brute([(r[0], r[2]) for r in rows])
    stored = {r.page_id: r.html for r in warc.read_archives(spark, path, payloads=True).filter("record_type = 'response'").collect()}
    assert stored[2] == big and stored[8] == "y" * 300_000


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_tables(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
    _, found = trip(spark, pages)
    assert sorted(map(tuple, found), key=repr) == brute([(r.page_id, r.html) for r in pages.collect()])


def test_empty(spark):
    assert trip(spark, spark.createDataFrame([], "page_id long, url string, html string"))[1] == []


def test_files_are_bounded_by_bytes(spark, tmp_path):
    """Large pages go to files of their own; every file is one or more whole records."""
    rows = [(i, f"http://{i}", chr(97 + i % 26) * (200_000 + i if i % 10 == 0 else 500 + i)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = fresh_path(spark, "archives")
    warc.write_archives(pages, path, file_bytes=1_000_000)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect()
    assert sum(f.length > 200_000 for f in files) >= 4 and max(f.length for f in files) < 1_200_000
    assert sum(1 for f in files for _ in warc.parse(bytes(f.content))) == 200
    assert sorted(map(tuple, warc.resolved_revisits(warc.read_archives(spark, path)).collect()), key=repr) == brute([(r[0], r[2]) for r in rows])


def test_small_and_single_payloads_take_no_part_in_the_join(spark):
    rows = [(i, None, "") for i in range(50)] + [(100 + i, None, str(i) * 2000) for i in range(8)] + [(200, None, "z" * 3000), (201, None, "z" * 3000)]
    resolved = warc.resolve(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.refers_to for r in resolved.filter("record_type = 'revisit'").collect()} == {200: 201}
    assert resolved.count() == len(rows)
