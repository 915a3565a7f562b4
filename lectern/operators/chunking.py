"""Chunking: pages to cleaned lines, headings, section runs and chunks with page provenance.

Input pages are (paper_id, source, page, text). Windows are always within one paper, ordered by page and line, so a task
holds one paper's rows at a time; chunk cutting is expressions on arrays of a run's pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapsed, slug, stripped

CHUNK_SIZE, OVERLAP, MIN_CHUNK = 1000, 150, 30
#: Sections that are kept in the raw chunk table but not indexed.
EXCLUDED_SECTIONS = ("references", "acknowledgments")
#: Section names and the headings that stand for them.
SECTION_ALIASES = {
    "abstract": ["abstract", "summary abstract"],
    "introduction": ["introduction", "intro", "introduction and background", "introduction and objectives", "introduction and scope"],
    "background": ["background", "theoretical background", "research background", "background and significance"],
    "methods": [
        "methods", "method", "materials and methods", "material and methods", "materials and method", "methodology", "experimental",
        "experimental section", "experimental methods", "experimental procedures", "materials and experimental", "theoretical methods",
        "computational methods", "computational details", "data and methods", "experimental setup",
    ],
    "results": ["results", "result", "results and discussion", "results and discussions", "results & discussion", "results and analysis"],
    "discussion": ["discussion", "discussions", "discussion and conclusions", "discussion and conclusion", "discussion and analysis"],
    "conclusion": ["conclusion", "conclusions", "concluding remarks", "summary and conclusions", "summary", "conclusions and outlook", "conclusions and future work"],
    "references": ["references", "reference", "bibliography", "literature cited", "reference list", "references and notes"],
    "supporting_information": [
        "supporting information", "supporting information available", "supplementary material", "supplementary materials", "supplementary information",
        "supplementary data", "electronic supplementary material", "si appendix", "supplementary note", "supplementary notes",
    ],
    "acknowledgments": ["acknowledgments", "acknowledgements", "acknowledgment", "acknowledgement", "acknowledgments and funding"],
}
#: What a numbered title may not hold, each with the reason that a refusal gives.
NUMBERED = r"^\s*(\d{1,2}(?:\.\d{1,2}){0,2})[.)]?\s+([A-Za-z\x{4e00}-\x{9fff}][^\n]*)$"
BARRED_TITLE_PATTERNS = {
    "authors": r"(?i)et\s+al\.?",
    "year": r"\b(?:19|20)\d{2}\b",
    "separator": ";",
    "link": r"(?i)\bdoi\s*[:.]?\s*10\.|https?://|www\.",
    "commas": r"(?s),.*,",
    "page range": r"\d+\s*[-–—]\s*\d+\s*[.]?$",
    "sentence break": r"[\p{L}\p{N}_]\.\s+[\p{L}\p{N}_]",
    "author and initial": r"^[A-Z][A-Za-z'’-]+,\s*[A-Z]\.",
    "formula": "[=×±≤≥·−→←↔↕•†‡°]|m−1|cm−1|s−1|m−3|d−1",
    "sentence word": (
        r"(?i)\b(must|should|can|could|will|would|may|might|shall|was|were|are|is|been|being|am|do|does|did|has|have|had|that|which|these|those|this|several|"
        r"many|such|both|each|however|therefore|thus|although|because|while|when|where|whether|so that|such as|due to)\b"
    ),
    "connector": (
        r"(?i)^(?:only|also|so|then|next|finally|lastly|moreover|furthermore|additionally|importantly|notably|interestingly|therefore|thus|hence|however|"
        r"nevertheless|nonetheless|although|though|whereas|meanwhile|but|and|or)\b"
    ),
    "small letter": r"^\s*[a-z]",
}
_EDGE = r"^[ .,:;\-–—]+|[ .,:;\-–—]+$"


def indexable(section: Column) -> Column:
    """Unknown and empty sections are indexable."""
    return ~F.lower(F.trim(F.coalesce(section, F.lit("")))).isin(*EXCLUDED_SECTIONS)


def canonical_section(name: Column) -> Column:
    """The section that a heading's wording stands for, or null."""
    plain = collapsed(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), _EDGE, ""))
    table = F.create_map(*(F.lit(x) for section, names in SECTION_ALIASES.items() for alias in names for x in (alias, section)))
    return F.try_element_at(table, plain)


def title_problem(title: Column) -> Column:
    """Why a numbered line's title is no heading, or null: its length, its number of words, or what it holds."""
    words = F.size(F.filter(F.split(title, r"(?U)\s+"), lambda x: x != ""))
    reasons = [F.when(~F.length(title).between(3, 50), "length"), F.when(~words.between(1, 6), "words")]
    return F.coalesce(*reasons, *(F.when(title.rlike(pattern), reason) for reason, pattern in BARRED_TITLE_PATTERNS.items()))


def with_headings(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds plain and full: the section label of a heading line without and with numbered headings, null for other lines.

    Each part that several rules read is a column of its own, so that it is computed once a row.
    """
    rows = lines.withColumn("_raw", stripped(F.coalesce(F.col(line), F.lit(""))))
    rows = rows.withColumns({"plain": F.when(F.length("_raw").between(1, 80), canonical_section(F.col("_raw"))), "_title": stripped(F.regexp_extract("_raw", NUMBERED, 2))})
    rows = rows.withColumn("_title", F.when(F.length("_title").between(3, 50), F.col("_title")))
    rows = rows.withColumn("_ok", F.col("_title").isNotNull() & title_problem(F.col("_title")).isNull())
    generic = F.trim(F.regexp_replace(F.regexp_replace(F.lower("_title"), r"(?U)\s+", " "), _EDGE, ""))
    rows = rows.withColumn("_generic", F.when(F.col("_ok"), generic))
    several = F.size(F.split("_generic", " ")) >= 2
    full = F.coalesce("plain", F.when(F.col("_ok"), F.coalesce(canonical_section(F.col("_title")), F.when(several, F.substring("_generic", 1, 80)))))
    return rows.withColumn("full", full).drop("_raw", "_title", "_ok", "_generic")


def clean_page(text: Column) -> Column:
    """White space collapsed line by line; empty lines and bare page numbers dropped."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), collapsed)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\d{1,4}$")), "\n")


def running_lines(pages: DataFrame) -> DataFrame:
    """paper_id, line, n_on, threshold: lines under 120 characters on 60 % of a paper's pages, three at least."""
    cleaned = pages.select("paper_id", "page", clean_page(F.col("text")).alias("text"))
    total = cleaned.groupBy("paper_id").agg(F.greatest(F.lit(3), F.floor(F.count("*") * 0.6 + 0.999)).cast("long").alias("threshold"))
    lines = cleaned.select("paper_id", "page", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    counts = lines.groupBy("paper_id", "line").agg(F.count("*").alias("n_on"))
    return counts.join(total, "paper_id").filter((F.col("n_on") >= F.col("threshold")) & (F.length("line") < 120))


def clean_lines(pages: DataFrame) -> DataFrame:
    """paper_id, page, pos, line: cleaned lines without running headers and footers; an emptied page keeps one empty line."""
    cleaned = pages.select("paper_id", "page", clean_page(F.col("text")).alias("text"))
    gone = running_lines(pages).groupBy("paper_id").agg(F.collect_set("line").alias("gone"))
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.coalesce("gone", F.array().cast("array<string>")), x))
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("")))
    return cleaned.join(gone, "paper_id", "left").select("paper_id", "page", F.posexplode(kept).alias("pos", "line"))


def section_runs(lines: DataFrame) -> DataFrame:
    """paper_id, run, section, pieces: consecutive text of one section, as (page, pos, text) pieces in order.

    Headings carry on over lines and pages; text before the first is front matter. From the first references heading on,
    numbered entries are no headings, which is why no recursion is needed: that line is judged with numbers allowed, and
    all lines behind it know that it came.
    """
    order = Window.partitionBy("paper_id").orderBy("page", "pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = with_headings(lines)
    in_references = F.coalesce(F.max(F.coalesce(F.col("full") == "references", F.lit(False))).over(before), F.lit(False))
    marked = marked.withColumn("h", F.when(in_references, F.col("plain")).otherwise(F.col("full")))
    marked = marked.withColumns({"seg": F.count("h").over(order), "section": F.coalesce(F.last("h", ignorenulls=True).over(order), F.lit("front_matter"))})
    body = marked.filter("h is null").groupBy("paper_id", "page", "seg", "section").agg(F.min("pos").alias("pos"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    pieces = body.select("paper_id", "page", "pos", "section", F.array_join("ls.line", " ").alias("text"))
    changed = F.coalesce((F.col("section") != F.lag("section").over(order)).cast("int"), F.lit(1))
    runs = pieces.withColumn("new", changed).withColumn("run", F.sum("new").over(order))
    grouped = runs.groupBy("paper_id", "run", "section").agg(F.sort_array(F.collect_list(F.struct("page", "pos", "text"))).alias("pieces"))
    return grouped.select("paper_id", F.col("run").cast("long").alias("run"), "section", "pieces")


def cut_fixed(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Character windows of every page, a tail that holds only overlap included; blank ones dropped, the rest numbered."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than chunk_size")
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(size - overlap))
    texts = F.transform(starts, lambda i: stripped(F.substring(F.col("text"), i + 1, F.lit(size))))
    kept = pages.filter(F.length("text") > 0).select("paper_id", "source", "page", F.posexplode(F.filter(texts, lambda x: x != "")).alias("chunk_index", "text"))
    name = F.concat("paper_id", F.lit("_p"), "page", F.lit("_c"), "chunk_index")
    return kept.select(name.alias("chunk_id"), "paper_id", "source", "page", "chunk_index", "text")


def _windows(runs: DataFrame, size: int, overlap: int) -> DataFrame:
    """The runs with i, text, page_start, page_end of each window of their pieces; ends with the one that reaches the end."""
    trimmed = F.transform("pieces", lambda p: F.struct(p["page"].alias("page"), stripped(p["text"]).alias("text")))
    rows = runs.withColumn("_kept", F.filter(trimmed, lambda p: p["text"] != "")).drop("pieces").filter(F.size("_kept") > 0)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,page:int>>").alias("all"))
    begins = F.aggregate(
        "_kept",
        start,
        lambda n, p: F.struct((n["at"] + F.length(p["text"]) + 1).alias("at"), F.concat(n["all"], F.array(F.struct(n["at"].alias("at"), p["page"].cast("int").alias("page")))).alias("all")),
        lambda n: n["all"],
    )
    rows = rows.withColumns({"_whole": F.array_join(F.col("_kept.text"), "\n"), "_begins": begins}).drop("_kept")
    total, step = F.length("_whole"), size - overlap
    n = F.when(total > size, F.ceil((total - size) / step) + 1).otherwise(1)
    rows = rows.withColumn("_s", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: (i * step).cast("int"))))
    page = lambda at: F.element_at(F.filter("_begins", lambda b: b["at"] <= at), -1)["page"]
    last = F.least(F.col("_s") + size, F.length("_whole")) - 1
    rows = rows.withColumns({"text": stripped(F.substring(F.col("_whole"), F.col("_s") + 1, F.lit(size))), "page_start": page(F.col("_s")), "page_end": page(last)})
    return rows.drop("_whole", "_begins")


def cut_sections(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, least: int = MIN_CHUNK) -> DataFrame:
    """Section-aware chunks; a paper without any heading falls back to windows over its cleaned pages.

    chunk_id, paper_id, section, page_start, page_end, chunk_index, text, chunking_mode; chunk_index counts over the paper.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than chunk_size")
    lines = clean_lines(pages)
    runs = section_runs(lines)
    only_front = runs.groupBy("paper_id").agg(F.bool_and(F.col("section") == "front_matter").alias("plain"))
    fallback = lines.groupBy("paper_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    fallback = fallback.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("page", F.lit(0).alias("pos"), "text"))).alias("pieces"))
    fallback = fallback.join(only_front.filter("plain"), "paper_id").select("paper_id", F.lit(1).cast("long").alias("run"), F.lit("body").alias("section"), "pieces", F.lit("fallback_fixed").alias("chunking_mode"))
    aware = runs.join(only_front.filter("not plain"), "paper_id").select("paper_id", "run", "section", "pieces", F.lit("section_aware").alias("chunking_mode"))
    rows = _windows(aware.unionByName(fallback), size, overlap).filter(F.length("text") >= least)
    rows = rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy("paper_id").orderBy("run", "_s")) - 1)
    name = F.concat("paper_id", F.lit("__"), slug(F.col("section")), F.lit("__p"), "page_start", F.lit("-"), "page_end", F.lit("__i"), "chunk_index")
    return rows.select(name.alias("chunk_id"), "paper_id", "section", "page_start", "page_end", "chunk_index", "text", "chunking_mode")


def build_chunks(pages: DataFrame, mode: str = "section_aware", **sizes: int) -> DataFrame:
    if mode == "section_aware":
        return cut_sections(pages, **sizes)
    if mode == "fixed":
        return cut_fixed(pages, **sizes)
    raise ValueError(f"unknown chunking mode: {mode}")


def enriched(chunks: DataFrame, meta: DataFrame, mode: str) -> DataFrame:
    """Title and DOI by paper_id, else by source; present values stay, chunk_id and the requested mode are set.

    ``meta`` is (key, title, doi) with a row for each file name and each stem.
    """
    def has(name: str) -> Column:
        return F.col(name) if name in chunks.columns else F.lit(None).cast("string")

    a = meta.select(F.col("key").alias("ka"), F.col("title").alias("ta"), F.col("doi").alias("da"))
    b = meta.select(F.col("key").alias("kb"), F.col("title").alias("tb"), F.col("doi").alias("db"))
    rows = chunks.join(a, F.col("paper_id") == F.col("ka"), "left").join(b, F.col("source") == F.col("kb"), "left")
    out = {
        "title": F.coalesce(has("title"), F.when(F.col("ka").isNotNull(), F.col("ta")).otherwise(F.col("tb")), F.lit("")),
        "doi": F.coalesce(has("doi"), F.when(F.col("ka").isNotNull(), F.col("da")).otherwise(F.col("db")), F.lit("")),
        "section": F.coalesce(has("section"), F.lit("unknown")),
        "page_start": F.coalesce(has("page_start").cast("int"), has("page").cast("int")),
        "page_end": F.coalesce(has("page_end").cast("int"), has("page").cast("int")),
        "built_mode": has("chunking_mode"),
        "chunking_mode": F.lit(mode),
    }
    return rows.withColumns(out).drop("ka", "ta", "da", "kb", "tb", "db")
