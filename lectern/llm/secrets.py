"""Secret scans: fixed patterns, and strings that zstandard can't predict from code, identifiers and their surroundings.

Base findings are patterns (assignments to a name that means a secret, access key ids, long hex runs). Beyond them, every
run of LEAST_CHARS secret characters or more within REACH characters of a sensitive name, before or behind it, is a
candidate; where the name is part of the run, the run goes on behind it. A candidate's novelty is what it adds to the
compressed size of the AROUND characters on both its sides, with a compressor primed with PRIMER, a dictionary of code and
identifiers: words, paths and names that the surroundings or the dictionary hold add little, keys add nearly all their
length. Candidates of letters and digits are reported from LEAST_NOVELTY; those of one kind only, which can be words, from
PLAIN_NOVELTY and PLAIN_CHARS characters: random ones are found from that length, words of everyday length aren't.
Candidates that overlap a base finding aren't reported twice.

Names, candidates and findings are looked for once each and merged in order, so a text costs time in proportion to its
length, however many names it holds.

Defined cases: null and empty texts hold nothing; very long texts are scanned whole; of findings at one place the kinds
come in their listed order; repeated rows are scanned alike; an empty table gives no rows; other columns are ignored.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAME = re.compile(r"pass(?:word|wd|phrase)?|secret|token|api_?key|private_?key|credential|auth(?:orization)?|bearer|signature|license_?key", re.I | re.A)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.A)
_JOINT = re.compile(r"[_=-]*")
#: Rows without any of these can't hold a finding; RE2 looks for them in whole Arrow columns.
_ANY = r"(?i)pass|secret|token|api_?key|private_?key|credential|auth|bearer|signature|license_?key|AKIA|[0-9a-f]{16}"
#: Characters between a sensitive name and a candidate at most, and on each side of it that it's measured against.
REACH = 60
AROUND = 400
#: Characters of a candidate, and the compressed bytes that it adds for each of its own, at least.
LEAST_CHARS = 16
LEAST_NOVELTY = 0.7
#: The same where it has letters only, or digits only.
PLAIN_CHARS = 24
PLAIN_NOVELTY = 0.75

PRIMER = " ".join(
    f"{pre}{name}{post}"
    for name in (
        "password passwd secret token api_key apikey private_key credential authorization bearer signature license_key username user_id email "
        "client_id client_secret access_key access_token refresh_token session_id database connection_string hostname localhost port timeout "
        "configuration environment development production staging default example placeholder changeme replace_with_your_key your-api-key-here "
        "https://www.example.com/path/to/resource application/json content-type text/html utf-8 function return import class public static void "
        "string integer boolean null true false undefined none self this const var let def get_value set_value from_environment "
        "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 xxxxxxxxxxxxxxxx 0000000000000000"
    ).split()
    for pre, post in (("", ""), ("", ' = "'), ("os.environ[", "]"))
).encode()


class Novelty:
    def __init__(self, primer: bytes = PRIMER, level: int = 6):
        words = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)

    def __call__(self, before: str, candidate: str, after: str = "") -> float:
        """Compressed bytes that ``candidate`` adds between its surroundings, for each of its own bytes."""
        without, whole = (before + after).encode(), (before + candidate + after).encode()
        return (len(self.compressor.compress(whole)) - len(self.compressor.compress(without))) / len(candidate.encode())


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """start, kind, end of the pattern findings, by start and then kind as listed."""
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """start, end of the runs near a sensitive name, in order."""
    names = [m.span() for m in _NAME.finditer(text)]
    if not names:
        return
    at = 0  # the first name that ends behind the run's start
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(names) and names[at][1] <= start:
            at += 1
        near = at > 0 and start - names[at - 1][1] <= REACH
        while at < len(names) and names[at][0] < end:  # names in the run
            near, start = True, min(names[at][1], end)
            at += 1
        if start > m.start():
            start = _JOINT.match(text, start, end).end()
        near = near or (at < len(names) and names[at][0] - end <= REACH)
        if near and end - start >= LEAST_CHARS:
            yield start, end


def is_novel(text: str, start: int, end: int, novelty: Novelty, least: float = LEAST_NOVELTY) -> bool:
    found = text[start:end]
    if not (any(c.isdigit() for c in found) and any(c.isalpha() for c in found)):
        least = max(least, PLAIN_NOVELTY)
        if len(found) < PLAIN_CHARS:
            return False
    return novelty(text[max(0, start - AROUND) : start], found, text[end : end + AROUND]) >= least


def novel_spans(text: str, base: list[tuple[int, str, int]], novelty: Novelty, least: float = LEAST_NOVELTY) -> list[tuple[int, str, int]]:
    """Novel candidates that don't overlap the findings ``base``, which are in order."""
    out, at, covered = [], 0, 0
    for start, end in candidates(text):
        while at < len(base) and base[at][0] < end:
            covered = max(covered, base[at][2])
            at += 1
        if covered <= start and is_novel(text, start, end, novelty, least):
            out.append((start, "novel", end))
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def scan(docs: DataFrame, least: float = LEAST_NOVELTY) -> DataFrame:
    """Counts, a digest of the base findings and all findings of every row of ``docs``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        none = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            likely = pc.match_substring_regex(text, _ANY).to_pylist()
            out = []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                if not likely[i]:
                    out.append((doc, *none))
                    continue
                t = text[i].as_py()
                base = base_spans(t)
                new = novel_spans(t, base, novelty, least)
                many = [sum(x[1] == k for x in base) for k in KINDS[:3]]
                every = sorted(base + new, key=lambda x: (x[0], KINDS.index(x[1])))
                out.append((doc, *many, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(new)))
            columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, _OUT)
