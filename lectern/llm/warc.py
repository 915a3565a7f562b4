"""WARC archives with resolved revisits.

Of pages with equal payloads of at least ``min_bytes`` the one with the largest page_id becomes the response record and
the others revisit it. Headers alone (digest and page_id, combined before the shuffle) tell which digests occur twice or
more and who answers for them; only these digests meet the pages again, so that payloads stay where they are while that
table is under the session's broadcast threshold, and travel once beyond it. Small payloads take no part in that join.

Archives are plain WARC files, written by Spark's own committed text writer, so that a lost executor leaves no torn file
and any Hadoop store will do. A file is a row in a worker when it's read, so files are bounded by bytes: pages of more than
LARGE bytes go to files of their own, with as many records as the largest of them allows.

Defined cases: a null html is an empty payload; a null url becomes ``urn:page:<id>``; control characters in a url are
percent-escaped; rows that repeat the response's page_id and payload are responses too; of these the greatest url is
referred to; a null page_id is the smallest and a payload all of whose ids are null has only responses; a page larger than
a file is a file of its own; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_BYTES = 1000
#: Bytes of an archive file's payloads at most, but for a single record that is larger, and of a page that isn't large.
FILE_BYTES = 64 << 20
LARGE = 64 << 10
CRLF = "\r\n"


def resolve(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html (null for revisits), payload_bytes, payload_digest, record_type, refers_to, refers_url."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(
            F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20\x7f]", "%20"),
            F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))),
        ).alias("url"),
        body.alias("html"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha1(F.encode(body, "UTF-8")).alias("payload_digest"),
    )
    large = rows.filter(F.col("payload_bytes") >= min_bytes)
    originals = large.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("_original"), F.count("*").alias("_n"))
    originals = stored(originals.filter("_n > 1").drop("_n"), "originals")
    revisit = F.col("_original.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_original.page_id"))
    small = rows.filter(F.col("payload_bytes") < min_bytes).withColumn("_original", F.lit(None).cast(originals.schema["_original"].dataType))
    return large.join(originals, "payload_digest", "left").unionByName(small).select(
        "page_id",
        "url",
        F.when(~revisit, F.col("html")).alias("html"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_original.page_id")).alias("refers_to"),
        F.when(revisit, F.col("_original.url")).alias("refers_url"),
    )


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.sha1(F.encode(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("none")), digest), "UTF-8"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(resolved: DataFrame, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """One ``value`` for each row: the WARC record up to the first of the two line ends behind its block."""
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF * 2),
    )
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    digest = F.col("payload_digest")
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), digest)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to"), digest))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("refers_url"))),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("_block").cast("string")),
    ]
    return resolved.withColumn("_block", block).select(
        F.concat(F.concat_ws(CRLF, *fields), F.lit(CRLF * 2), F.col("_block"), F.lit(CRLF)).alias("value")
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write deduplicated archives below ``path``, FILE_BYTES of payloads a file at most."""
    rows = resolve(pages, min_bytes)
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    for name, some, bytes_each in (("pages", F.col("payload_bytes") <= LARGE, LARGE), ("large", F.col("payload_bytes") > LARGE, largest)):
        if name == "pages" or largest > LARGE:
            many = max(1, file_bytes // bytes_each)
            records(rows.filter(some)).write.option("lineSep", CRLF).option("maxRecordsPerFile", many).text(f"{path}/{name}")


_SCHEMA = "page_id long, url string, record_type string, digest string, refers_to long, bytes long, sha1 string, html string"


def parse(data: bytes) -> Iterator[dict]:
    """The records of one archive, by their Content-Length, never by looking for a separator in payloads."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        field = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(field["Content-Length"])
        yield field | {"block": data[start:stop]}
        at = stop + 4


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records below ``path``; bytes and sha1 are of the stored payload, null for revisits."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                out = []
                for r in parse(bytes(data)):
                    full = r["WARC-Type"] != "revisit"
                    body = r["block"][re.search(rb"\r\n\r\n", r["block"]).end() :]
                    out.append(
                        (
                            int(r["X-Page-ID"]) if "X-Page-ID" in r else None,
                            r["WARC-Target-URI"],
                            r["WARC-Type"],
                            r["WARC-Payload-Digest"].removeprefix("sha1:"),
                            int(r["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in r else None,
                            len(body) if full else None,
                            hashlib.sha1(body).hexdigest() if full else None,
                            body.decode() if full and payloads else None,
                        )
                    )
                names = [x.split()[0] for x in _SCHEMA.split(", ")]
                frame = pd.DataFrame(out, columns=names)
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64", "bytes": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(load, _SCHEMA)


def resolved_revisits(archive: DataFrame) -> DataFrame:
    """Each record with the size and digest of its full payload: a revisit's are those of the response it refers to.

    A stored payload that differs from its header's digest, or a revisit without response, fails the run.
    """
    own = F.when(F.col("sha1") == F.col("digest"), F.col("sha1")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its digest: page "), F.col("page_id").cast("string")))
    )
    answers = archive.filter("record_type = 'response'")
    revisits = archive.filter("record_type = 'revisit'").select("page_id", "record_type", "digest", "refers_to")
    sizes = answers.groupBy("digest").agg(F.max("bytes").alias("bytes"), F.max("page_id").alias("_id"))
    found = F.when(F.col("_id").eqNullSafe(F.col("refers_to")), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.col("refers_to").cast("string")))
    )
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        answers.withColumns({"payload_bytes": F.col("bytes"), "payload_digest": own})
        .select(cols)
        .unionByName(
            revisits.join(sizes, "digest", "left")
            .withColumns({"payload_bytes": F.col("bytes"), "payload_digest": found})
            .select(cols)
        )
    )
