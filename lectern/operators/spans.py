"""Gold spans, pages and sections: where evidence stands in chunks, and which hits reach it.

A span is looked for by an equi join. After normalisation words are separated by single blanks, so that the inner words of a
span stand as whole words in every text that holds it: three of them (one, in spans of three or four words) are the key
that leads a span to the texts worth searching. Only spans of one or two words are held against every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import evidence_norm, let
from lectern.sources.places import written

#: Words of a key, and the spans (in words) that are long enough for it.
KEY, LONG, SHORT = 3, 5, 3
#: What ends a sentence, and what is trimmed from the ends of a span.
ENDS = r".。!?！？;；"
TRIMMED = r" .;:,\-"


def _keys(words: Column) -> Column:
    """Hashes of all runs of KEY words, and of all single words, of an array of words."""

    def run(n: int) -> Column:
        parts = lambda i: F.xxhash64(F.lit(n), *(F.element_at(words, i + j) for j in range(n)))
        every = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), parts)
        return F.when(F.size(words) >= n, every).otherwise(F.array().cast("array<long>"))

    return F.array_distinct(F.concat(run(KEY), run(1)))


def holding(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """case_id, id: every chunk (id, text) that holds a case's span (case_id, gold) after normalisation; empty spans are nowhere."""
    words = F.split("g", " ")
    inner = lambda n: F.xxhash64(F.lit(n), *(F.element_at(words, 2 + j) for j in range(n)))
    key = F.when(F.size(words) >= LONG, inner(KEY)).when(F.size(words) >= SHORT, inner(1))
    wanted = cases.select("case_id", evidence_norm(F.col("gold")).alias("g")).filter("g <> ''").withColumn("key", key)
    there = written(chunks.select("id", evidence_norm(F.col("text")).alias("t")), "normal")  # made once, read three times
    keyed = wanted.filter("key is not null")
    met = there.select("id", F.explode(let(F.split("t", " "), _keys)).alias("key")).join(keyed.select("case_id", "key"), "key")
    candidates = met.select("case_id", "id").distinct().join(keyed.select("case_id", "g"), "case_id")
    found = there.join(candidates, "id").filter(F.col("t").contains(F.col("g"))).select("case_id", "id")
    tiny = wanted.filter("key is null").select("case_id", "g")
    return found.unionByName(there.join(tiny, F.col("t").contains(F.col("g"))).select("case_id", "id")).distinct()


def located(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """case_id, id, n_places: of the chunks that hold a span the first (by id); one that has the hinted page comes before.

    ``cases``: case_id, gold and, as a hint, page; ``chunks``: id, text and, for hints, page_start and page_end.
    """
    found = holding(cases, chunks)
    on_page = F.lit(0)
    if "page" in cases.columns:
        found = found.join(cases.select("case_id", "page"), "case_id").join(chunks.select("id", "page_start", "page_end"), "id")
        on_page = F.when(F.col("page").between(F.col("page_start"), F.col("page_end")), 0).otherwise(1)
    best = found.groupBy("case_id").agg(F.min(F.struct(on_page.alias("off"), "id")).alias("best"), F.count("*").alias("n_places"))
    return cases.select("case_id").join(best.select("case_id", "best.id", "n_places"), "case_id", "left")


def sentence_window(text: Column, span: Column) -> Column:
    """The sentences around the first place of ``span`` in ``text`` (whatever their case), trimmed; null where it isn't there."""
    at = F.instr(F.lower(text), F.lower(span))
    before = F.regexp_extract(F.substring(text, F.lit(1), at - 1), f"[^{ENDS}]*$", 0)
    held = F.substring(text, at, F.length(span))
    rest = F.substring(text, at + F.length(span), F.length(text))
    after = F.when(held.rlike(f"[{ENDS}]$"), F.lit("")).otherwise(F.regexp_extract(rest, f"^[^{ENDS}]*[{ENDS}]?", 0))
    whole = F.regexp_replace(F.concat(before, held, after), r"(?U)\s+", " ")
    return F.when(at > 0, F.regexp_replace(whole, f"^[{TRIMMED}]+|[{TRIMMED}]+$", ""))


def page_hits(gold: DataFrame, hits: DataFrame, missing_page: bool = False) -> DataFrame:
    """case_id, paper_rank, page_rank: the first 1-based ranks of a hit on the gold paper, and of one that spans its gold page.

    ``gold``: case_id, paper_id, page; ``hits``: case_id, rank (from 1), paper_id, page_start, page_end. A hit without pages
    reaches no page, or with ``missing_page`` stands for pages from 0 to the gold page.
    """
    page, low, high = F.col("g.page"), F.col("h.page_start"), F.col("h.page_end")
    if missing_page:
        low, high = F.coalesce(low, F.lit(0)), F.coalesce(high, page)
    both = gold.alias("g").join(hits.alias("h"), F.expr("g.case_id = h.case_id and g.paper_id = h.paper_id"), "left")
    return both.groupBy(F.col("g.case_id").alias("case_id")).agg(
        F.min("h.rank").alias("paper_rank"), F.min(F.when(page.between(low, high), F.col("h.rank"))).alias("page_rank")
    )


def span_hits(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """case_id, span_rank: the first rank of a hit whose text holds the gold text; ``gold``: case_id, gold; ``hits`` with text."""
    both = gold.select("case_id", evidence_norm(F.col("gold")).alias("g")).join(hits, "case_id", "left")
    held = (F.col("g") != "") & evidence_norm(F.col("text")).contains(F.col("g"))
    return both.groupBy("case_id").agg(F.min(F.when(held, F.col("rank"))).alias("span_rank"))


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """One row over (paper_rank, page_rank, span_rank): recall, page and span hits at 5 and 10, and MRR at 10."""
    within = lambda c, k: F.coalesce((F.col(c) <= k).cast("int"), F.lit(0))
    mean = lambda c: F.round(F.avg(c), 4)
    return ranks.agg(
        F.count("*").alias("n"), *(mean(within("paper_rank", k)).alias(f"recall{k}") for k in (5, 10)),
        mean(F.when(F.col("paper_rank") <= 10, 1 / F.col("paper_rank")).otherwise(0.0)).alias("mrr10"),
        *(mean(within(f"{x}_rank", k)).alias(f"{x}_hit{k}") for x in ("page", "span") for k in (5, 10)),
    )


def section_map(chunks: DataFrame) -> DataFrame:
    """paper_id, page, sections (sorted): what stands on each page that a chunk spans."""
    pages = chunks.select("paper_id", "section", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return pages.groupBy("paper_id", "page").agg(F.array_sort(F.collect_set("section")).alias("sections"))


def references_share(gold: DataFrame, hits: DataFrame, sections: DataFrame) -> DataFrame:
    """case_id, n_gold, n_references, share: of a case's hits on its gold paper, those that reach a references page."""
    mine = gold.select("case_id", "paper_id").join(hits, ["case_id", "paper_id"])
    first = F.coalesce("page_start", F.lit(0))
    pages = mine.select("case_id", "paper_id", "rank", F.explode(F.sequence(first, F.greatest(first, F.coalesce("page_end", first)))).alias("page"))
    listed = sections.filter(F.array_contains("sections", "references")).select("paper_id", "page", F.lit(1).alias("listed"))
    by_hit = pages.join(listed, ["paper_id", "page"], "left").groupBy("case_id", "rank").agg(F.max(F.coalesce("listed", F.lit(0))).alias("listed"))
    counts = by_hit.groupBy("case_id").agg(F.count("*").alias("n"), F.sum("listed").alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = gold.select("case_id").join(counts, "case_id", "left")
    return rows.select("case_id", zero("n").alias("n_gold"), zero("m").alias("n_references"), F.round(zero("m") / F.greatest(F.lit(1), zero("n")), 4).alias("share"))


def page_range_text(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """case_id, text: the pages from page_start to page_end of a paper, one a line block; pages that aren't there are left out.

    ``spans``: case_id, paper_id, page_start, page_end; ``pages``: paper_id, page, text.
    """
    met = spans.join(pages, "paper_id").filter(F.col("page").between(F.col("page_start"), F.col("page_end")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    texts = met.groupBy("case_id").agg(F.array_join(parts, "\n").alias("text"))
    return spans.select("case_id").join(texts, "case_id", "left").select("case_id", F.coalesce("text", F.lit("")).alias("text"))


def expected_sources(cases: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """case_id, expected, matched, recall, first_rank, mrr over the first ``k`` hits of a case.

    ``cases``: case_id, expected_sources (array); a hit (rank from 1, source, paper_id) matches an expectation that is part
    of its source's or paper's name. Cases without expectations have recall 0.
    """
    wanted = cases.select("case_id", F.array_distinct(F.coalesce("expected_sources", F.array().cast("array<string>"))).alias("wanted"))
    top = wanted.join(hits.filter(F.col("rank") <= k), "case_id", "left")
    inside = F.filter("wanted", lambda x: F.coalesce(F.col("source").contains(x) | F.col("paper_id").contains(x), F.lit(False)))
    rows = top.select("case_id", "wanted", "rank", inside.alias("found"))
    score = rows.groupBy("case_id").agg(
        F.first(F.size("wanted")).alias("expected"), F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("matched"),
        F.min(F.when(F.size("found") > 0, F.col("rank"))).alias("first_rank"),
    )
    recall = F.when(F.col("expected") > 0, F.round(F.col("matched") / F.col("expected"), 6)).otherwise(0.0)
    mrr = F.when(F.col("first_rank").isNotNull(), F.round(1 / F.col("first_rank"), 6)).otherwise(0.0)
    return score.select("case_id", "expected", "matched", recall.alias("recall"), "first_rank", mrr.alias("mrr"))


def failure_mode() -> Column:
    """The category of a case over the hits of three configurations: dense_span, paper, page, span (a fixed hybrid's), other_span.

    Fixed values: the labels. The first rule that holds wins.
    """
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        F.when(~on("dense_span") & on("span"), "A_dense_miss_hybrid_rescue")
        .when(on("span") & ~on("other_span"), "B_fixed_hit_section_miss")
        .when(on("other_span") & ~on("span"), "C_section_hit_fixed_miss")
        .when(on("paper") & ~on("page"), "D_paper_hit_wrong_page")
        .when(~on("paper"), "E_paper_page_miss")
        .when(on("page") & ~on("span"), "F_page_hit_but_span_miss")
        .otherwise("OK_span_hit")
    )


def mode_ablation(rows: DataFrame) -> DataFrame:
    """One row a mode over (mode, error, hit5, hit10, recall5, recall10, mrr, latency_ms): sums over all cases, failed ones too."""
    share = lambda c: F.round(F.sum(F.when(F.col("error").isNull(), F.col(c)).otherwise(0)) / F.count("*"), 6)
    names = ("hit5", "hit10", "recall5", "recall10", "mrr", "latency_ms")
    return rows.groupBy("mode").agg(F.count("*").alias("cases"), F.count("error").alias("errors"), *(share(c).alias(c) for c in names))


def first_cases(cases: DataFrame, n: int, order: str = "case_id") -> DataFrame:
    """The first ``n`` cases in their file's order, which is a column here."""
    return cases.orderBy(order).limit(n)


def ranked_hits(hits: DataFrame) -> DataFrame:
    """Hits (query_id, rank from 0) as (case_id, rank from 1), with what else they hold."""
    return hits.withColumn("rank", F.col("rank") + 1).withColumnRenamed("query_id", "case_id")

