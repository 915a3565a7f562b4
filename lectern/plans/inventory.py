"""Queries over papers' first pages, their dedup in stages, and how they are got.

The supplied texts have no titles, authors or dates, so each document gets one of twelve first pages put before it, by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import inventory as I
from lectern.functions import text as T
from lectern.operators import acquisition as Q
from lectern.operators import corpus as C
from lectern.operators import dedup as D

from . import adapters as A
from . import corpus as P
from .registry import registry

QUERIES, ORACLES, query = registry()

FIRST_PAGES = (
    "Contents lists available at ScienceDirect\nWater Research\njournal homepage: www.elsevier.com/locate/watres\nResearch article\n"
    "Catalytic ozonation of emerging contaminants in\nurban wastewater by manganese oxides.\nJohn Smith, Ann Lee and Wei Zhang\n"
    "School of Environment, 10084\nAbstract\nWe did it.\nKeywords: ozone\n© 2019 Elsevier Ltd. doi:10.1016/j.watres.2019.11502.",
    "Corrigendum to a paper on membranes\nPublished 3 May 2018",
    "Supporting Information for\nAdsorption of pharmaceuticals\nFigure S1. Figure S2. Table S3. Fig. S4. Figure S5. Scheme S6",
    "Access denied\nPlease sign in to continue <html>",
    "Table of contents\nVolume 3",
    "Editorial\n\nOn the state of rivers, by the editors of this journal\nReceived 1 May 2015; accepted 2 June 2016",
    "Persulfate activation by iron minerals: kinetics and products\nSmith, J.; Doe, A.\nA B S T R A C T\nThe rates were measured in 1998 and 2004\n1. Introduction more",
    "",
    "Chemosphere 23, 2004, vol. 12, pp. 3\nAn accepted manuscript about a fairly long title that goes on and on over lines\n"
    "and continues here without a stop\nand again here it goes\nMueller-Linden, K., Green, B.\nreferences",
    "International Journal of Chemistry\nLetter\nShort\n1984 was a year, 1985 too, 1985",
    "Downloaded via the web\nPhotocatalysis under visible light for water reuse and beyond it.\nAnn Lee*, John Smith\nAvailable online at www.sciencedirect.com today",
    "doi: 10.1021/acs.est.0c01234.\nBook review\nCopyright © 2021",
)
META_TITLES = (
    "Untitled", "Microsoft Word", "paper-final.pdf", "PII: S0043-1354(19)30001", "1-s2.0-S0043135419300012-main", "A study of rivers and lakes", "123 - 456", "Word",
    "Oneverylongwordwithoutanyblankinit", "  Ozone\n in   drinking water ", "",
)
FILES = ("污水中抗生素的去除研究_张三.pdf", "short.pdf", "A_long_file_name.PDF", "x.pdf", "河流沉积物中微塑料的分布特征.pdf")

_FIRST = f"""fp AS (SELECT doc_id, source, text, concat_ws(chr(10), {A.sql_list(FIRST_PAGES)}[doc_id % {len(FIRST_PAGES)} + 1], text) AS first, doc_id % 9 + 1 AS pages,
  length(text) AS n, CASE WHEN doc_id % 7 = 0 THEN {A.sql_list(META_TITLES)}[doc_id % {len(META_TITLES)} + 1] ELSE '' END AS meta FROM documents)"""


def papers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    return A.read(spark, d, "documents").select(
        "doc_id", "source", "text", F.concat_ws("\n", pick(FIRST_PAGES), "text").alias("first"), (i % 9 + 1).alias("pages"), F.length("text").alias("n"),
        F.when(i % 7 == 0, pick(META_TITLES)).otherwise("").alias("meta"),
    )


def _flat(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def _h(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {A.q(pattern)})"


def _any(c: str, phrases) -> str:
    return f"len(list_filter({A.sql_list(phrases)}, lambda p: contains({c}, p))) > 0"


_META_OK = f"""CASE WHEN {_h('t', I.JUNK_TITLE)} OR {_h('t', I.FILE_TITLE)} OR {_h('t', I.CODE_TITLE)} OR NOT {_h('t', '[A-Za-z一-鿿]{3}')}
  OR (NOT contains(t, ' ') AND length(t) < 25) THEN '' ELSE t END"""
_STEM = "trim(replace(regexp_replace(regexp_replace(f, '(?i)\\.pdf$', ''), '_[一-鿿]{2,4}$', ''), '_', ' '))"


@query(f"""WITH s AS (SELECT doc_id, {_flat(f"{A.sql_list(META_TITLES)}[doc_id % {len(META_TITLES)} + 1]")} AS t, {A.sql_list(FILES)}[doc_id % {len(FILES)} + 1] AS f FROM documents)
SELECT doc_id, {_META_OK} AS meta_title, CASE WHEN length({_STEM}) >= 6 THEN {_STEM} ELSE '' END AS file_title,
  length({_STEM}) BETWEEN 6 AND 90 AND NOT {_h(_STEM, I.CITATION_WORDS)} AND NOT {_h(_STEM, I.THESIS_WORDS)} AND len(regexp_extract_all({_STEM}, '[一-鿿]')) >= 5
  AND len(regexp_extract_all({_STEM}, '[\\d,;.()\\[\\]]')) <= length({_STEM}) * 0.3 AS chinese FROM s""")
def meta_titles(spark, d):
    i = F.col("doc_id")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    rows = A.read(spark, d, "documents").select("doc_id", pick(META_TITLES).alias("t"), pick(FILES).alias("f"))
    stem = F.trim(F.replace(F.regexp_replace(F.regexp_replace("f", r"(?i)\.pdf$", ""), "_[一-鿿]{2,4}$", ""), F.lit("_"), F.lit(" ")))
    return rows.select("doc_id", I.meta_title(F.col("t")).alias("meta_title"), I.file_title(F.col("f")).alias("file_title"), I.chinese_title(stem).alias("chinese"))


_MAST = f"""(len(string_split_regex(trim(x), '\\s+')) <= 12 AND ({_h('x', I.JOURNAL_LINE)}
  OR len(list_filter({A.sql_list(I.JOURNALS)}, lambda h: contains(lower(x), h) AND length(lower(x)) - length(h) < 12)) > 0))"""
_USABLE = f"""NOT ({_h('x', I.BOILER_LINE)} OR {_h('x', I.SECTION_LABEL)} OR {_MAST}) AND length(x) BETWEEN 12 AND 300 AND NOT {_h('x', I.AUTHORS)} AND NOT {_h('x', I.PLACES)}"""
_TITLES = f"""{_FIRST},
tl AS (SELECT doc_id, list_filter(list_transform(string_split(left(first, 3000), chr(10)), lambda x: {_flat('x')}), lambda x: x <> '')[1:30] AS ls FROM fp),
tg AS (SELECT *, list_transform(ls, lambda x: {_USABLE}) AS good FROM tl),
ts AS (SELECT *, list_position(good, true) AS a FROM tg),
te AS (SELECT *, list_position(good[a:], false) AS e FROM ts),
tr AS (SELECT doc_id, CASE WHEN a IS NULL OR a = 0 THEN [] WHEN e > 0 THEN ls[a:a + e - 2] ELSE ls[a:] END AS run FROM te),
tj AS (SELECT doc_id, run, list_transform(range(1, len(run) + 1), lambda i: array_to_string(run[1:i], ' ')) AS js FROM tr),
tc AS (SELECT *, list_filter(range(1, len(run) + 1), lambda i: length(js[i]) > 60 AND (ends_with(js[i], '.') OR i >= 3)) AS cs FROM tj),
tt AS MATERIALIZED (SELECT doc_id, regexp_replace(CASE WHEN len(run) = 0 THEN '' WHEN len(cs) > 0 THEN js[cs[1]] ELSE js[len(run)] END, '^[ .,;:\\-–—]+|[ .,;:\\-–—]+$', '', 'g') AS t FROM tc),
titles AS MATERIALIZED (SELECT doc_id, CASE WHEN length(t) > 15 THEN t ELSE '' END AS title FROM tt)"""


@query(f"WITH {_TITLES} SELECT doc_id, title FROM titles")
def title_from_text(spark, d):
    return papers(spark, d).select("doc_id", I.text_title(F.col("first")).alias("title"))


# --- titles by layout: the blocks of web pages set in lines of forty characters, with sizes by tag

_BLOCK = r"<(h1|p|li|div|b)(?:\s[^>]*)?>([^<]+)"
_LINE = ".{1,40}"
PAGE = 800.0


def laid_lines(spark: SparkSession, d: str) -> DataFrame:
    """page_id, lines of ``pages``: lists in small type, headings in large type, of which some lines are a little smaller.

    In every fourth page a heading's later lines stand far below; in every fifth an advertisement is as large as the heading,
    in every seventh the heading is no larger than the text.
    """
    i = F.col("page_id")
    tags, texts = (F.regexp_extract_all("html", F.lit(_BLOCK), F.lit(g)) for g in (1, 2))
    cut = lambda b: F.transform(
        F.regexp_extract_all(b["text"], F.lit(_LINE), F.lit(0)), lambda t, j: F.struct(b["tag"].alias("tag"), t.alias("text"), j.alias("j"))
    )
    blocks = F.transform(F.arrays_zip(tags.alias("tag"), texts.alias("text")), lambda b: F.struct(b["tag"].alias("tag"), b["text"].alias("text")))
    size = lambda x: (
        F.when((x["tag"] == "h1") & (i % 7 != 0), F.when(x["j"] == 1, 17.54).otherwise(18.04)).when((x["tag"] == "div") & (i % 5 == 0), 18.0).otherwise(10.0)
    )
    below = lambda x: F.when((x["tag"] == "h1") & (x["j"] >= 1) & (i % 4 == 0), 100.0).otherwise(0.0)
    spans = lambda x: F.array(
        F.struct(F.substring(x["text"], 1, 10).alias("text"), size(x).alias("size")),
        F.struct(F.substring(x["text"], 11, 40).alias("text"), (size(x) - 2.0).alias("size")),
    )
    flat = F.flatten(F.transform(blocks, cut))
    lines = F.transform(flat, lambda x, k: F.struct((F.lit(20.0) + k * 14 + below(x)).alias("y"), spans(x).alias("spans")))
    return A.read(spark, d, "pages").select("page_id", lines.alias("lines"))


@query(f"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, {A.q(_BLOCK)}, 1)) AS tag, unnest(regexp_extract_all(html, {A.q(_BLOCK)}, 2)) AS t,
  unnest(range(len(regexp_extract_all(html, {A.q(_BLOCK)})))) AS k FROM pages),
l AS (SELECT page_id, tag, k, unnest(regexp_extract_all(t, {A.q(_LINE)})) AS t, unnest(range(len(regexp_extract_all(t, {A.q(_LINE)})))) AS j FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k, j) - 1 AS i FROM l),
s AS (SELECT page_id, i, {_flat('t')} AS x, 20.0 + i * 14 + CASE WHEN tag = 'h1' AND j >= 1 AND page_id % 4 = 0 THEN 100 ELSE 0 END AS y,
  CASE WHEN tag = 'h1' AND page_id % 7 <> 0 THEN CASE WHEN j = 1 THEN 17.5 ELSE 18.0 END WHEN tag = 'div' AND page_id % 5 = 0 THEN 18.0 ELSE 10.0 END AS size FROM n),
u AS (SELECT *, y < {PAGE}::DOUBLE * {I.TITLE_PART}::DOUBLE AS up FROM s WHERE length(x) > {I.TITLE_LINE} AND NOT ({_h('x', I.BOILER_LINE)} OR {_h('x', I.SECTION_LABEL)} OR {_MAST})),
p AS (SELECT *, bool_or(up) OVER (PARTITION BY page_id) AS any_up FROM u),
m AS (SELECT *, max(size) OVER (PARTITION BY page_id) AS most FROM p WHERE up OR NOT any_up),
g AS (SELECT *, y - lag(y) OVER (PARTITION BY page_id ORDER BY y, i) >= most * {I.LINE_GAP} AS opens FROM m WHERE size >= most - {I.SIZE_SLACK}),
e AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y, i) AS island FROM g),
t AS (SELECT page_id, regexp_replace(string_agg(x, ' ' ORDER BY y, i), '^[ .,;:\\-–—]+|[ .,;:\\-–—]+$', '', 'g') AS t FROM e WHERE island = 0 GROUP BY page_id)
SELECT page_id, CASE WHEN length(t) > {I.LAID_TITLE} THEN t ELSE '' END AS title FROM pages LEFT JOIN t USING (page_id)""")
def title_by_layout(spark, d):
    """Titles of pages by the sizes and heights of their lines."""
    return laid_lines(spark, d).select("page_id", I.layout_title(F.col("lines"), F.lit(PAGE)).alias("title"))


_NORM = f"trim(regexp_replace(lower({A.decomposed_sql('{0}')}), '[^a-z0-9]+', ' ', 'g'))"
_AUTHORS = f"""{_TITLES},
al AS (SELECT doc_id, title, list_filter(list_transform(string_split(first, chr(10)), lambda x: {_flat('x')}), lambda x: x <> '') AS ls FROM fp JOIN titles USING (doc_id)),
ax AS (SELECT doc_id, ls, coalesce(list_max(list_filter(range(1, least(40, len(ls)) + 1), lambda i: length({_NORM.format('ls[i]')}) > 15 AND contains({_NORM.format('title')}, {_NORM.format('ls[i]')}))), 0) AS s FROM al),
aw AS (SELECT doc_id, ls[s + 1:s + 14] AS w FROM ax),
ae AS (SELECT doc_id, w, list_position(list_transform(w, lambda x: {_h('x', I.WINDOW_END)}), true) AS e FROM aw),
ab AS (SELECT doc_id, CASE WHEN e > 0 THEN w[1:e - 1] ELSE w END AS w FROM ae),
au AS MATERIALIZED (SELECT doc_id, list_filter(w, lambda x: NOT {_h('x', I.BOILER_LINE)} AND length(x) BETWEEN 5 AND 400 AND ({_h('x', chr(92) + 'b(and|&)' + chr(92) + 'b|,')} OR {_h('x', I.AUTHOR_LINE)})
  AND len(regexp_extract_all(x, {A.q(I.NAME)})) >= 2 AND NOT {_h('x', I.AUTHOR_PLACES)})[1] AS line FROM ab)"""
_HEAD4 = "left(first, 4000)"


@query(f"""WITH {_AUTHORS}, jr AS (SELECT doc_id, list_filter({A.sql_list(I.JOURNALS)}, lambda h: contains(lower({_HEAD4}), h))[1] AS j, {_HEAD4} AS h FROM fp)
SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'Jane Roe' ELSE coalesce(line, '') END AS authors, CASE WHEN doc_id % 13 = 0 THEN 'metadata' WHEN line IS NOT NULL THEN 'layout' ELSE 'none' END AS how,
  CASE WHEN doc_id % 17 = 0 THEN 'Journal of Tests' WHEN j IS NOT NULL THEN trim(substr(h, instr(lower(h), j), length(j)))
  ELSE left(regexp_replace(regexp_extract(h, {A.q(I.JOURNAL_PAGE)}), '\\s+', ' ', 'g'), 120) END AS journal FROM au JOIN jr USING (doc_id)""")
def author_journal(spark, d):
    i, first = F.col("doc_id"), F.col("first")
    rows = papers(spark, d).withColumn("title", I.text_title(first))
    who = I.authors_of(F.when(i % 13 == 0, "Jane Roe"), first, F.col("title"))
    journal = I.journal_of([F.when(i % 19 == 0, "10.1/x"), F.when(i % 17 == 0, " Journal of  Tests ")], first)
    return rows.select("doc_id", who.alias("w"), journal.alias("journal")).select("doc_id", "w.authors", "w.how", "journal")


def _y(pattern: str, how: str) -> str:
    return f"WHEN regexp_extract(h, {A.q(pattern)}, 1) <> '' THEN {{'y': regexp_extract(h, {A.q(pattern)}, 1)::INT, 'how': '{how}'}}"


_Y = I.YEAR
_YEARS = " ".join((
    _y(rf"(?i)©\s*(?:copyright\s*)?{_Y}", "copyright"), _y(rf"(?i)copyright\s*©?\s*{_Y}", "copyright"), _y(rf"(?i)published\D{{0,40}}?{_Y}", "published"),
    _y(rf"(?i)accepted\D{{0,40}}?{_Y}", "accepted"), _y(rf"(?i)received\D{{0,40}}?{_Y}", "received"), _y(rf"(?i)\b{_Y}\b\s*[,;]?\s*(?:vol|no\.|pp\.)", "citation"),
))


@query(f"""WITH {_FIRST}, x AS (SELECT doc_id, first, left(first, 6000) AS h, CASE WHEN doc_id % 11 = 0 THEN 'D:2012' ELSE '' END AS c FROM fp),
y AS (SELECT doc_id, first, CASE {_YEARS} WHEN c <> '' THEN {{'y': 2012, 'how': 'meta:creationDate'}}
  WHEN len(regexp_extract_all(h, {A.q(_Y)})) > 0 THEN {{'y': list_max(regexp_extract_all(h, {A.q(_Y)}))::INT, 'how': 'first_page_max'}} ELSE {{'y': NULL, 'how': 'none'}} END AS r FROM x),
u AS (SELECT doc_id, unnest(regexp_extract_all(left(first, 3000), {A.q(I.INVENTORY_YEAR)}, 1)) AS v FROM y),
m AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, v DESC) AS k FROM u GROUP BY 1, 2)
SELECT y.doc_id, r.y AS year, r.how AS how, m.v::INT AS usual_year FROM y LEFT JOIN m ON m.doc_id = y.doc_id AND k = 1""")
def year_extract(spark, d):
    first = F.col("first")
    rows = papers(spark, d).withColumn("y", I.year_of(first, F.when(F.col("doc_id") % 11 == 0, "D:2012")))
    return rows.select("doc_id", "y.year", "y.how", I.usual_year(first).alias("usual_year"))


_REFS = "len(list_filter(['references', 'bibliography', 'literature cited', '参考文献'], lambda p: contains(lower(right(first, greatest(2000, floor(length(first) * 0.35)::INT))), p))) > 0"
_LEAD = r"trim(regexp_replace(left(first, 400), '[ \t]+', ' ', 'g'))"
_TYPED = f"""{_TITLES},
mk AS (SELECT fp.doc_id, n, pages, lower(regexp_replace(left(first, 4000), '\\s+', ' ', 'g')) || ' ' || lower(title) AS probe, ({_h(_LEAD, I.SUPPLEMENT_LEADS[0])} OR {_h(_LEAD, I.SUPPLEMENT_LEADS[1])}) AS si,
  len(regexp_extract_all(lower(first), {A.q(I.SUPPLEMENT_FIGURE)})) AS own, len(regexp_extract_all(lower(first), {A.q(I.FIGURE)})) AS fig,
  {_h("left(lower(regexp_replace(left(first, 6000), '" + chr(92) + "s+', ' ', 'g')), 3500)", I.ABSTRACT)} AS abs, {_REFS} AS refs,
  ({_h('left(first, 1200)', I.EDITORIAL_LABELS[0])} OR {_h('trim(first)', I.EDITORIAL_LABELS[1])}) AS lab FROM fp JOIN titles USING (doc_id)),
sg AS (SELECT *, {_any('probe', I.ERROR_PAGES)} AS err, {_any('probe', I.CORRIGENDA)} AS cor, {_any('probe', I.CONTENTS)} AS toc,
  {' OR '.join(_h('probe', f'(?:^|{chr(92)}W){p}(?:{chr(92)}W|$)') for p in I.EDITORIALS)} AS edi FROM mk),
ty AS (SELECT doc_id, CASE WHEN err AND (n < 6000 OR pages <= 2) THEN 'error_or_login_page' WHEN n < 200 THEN 'no_extractable_text' WHEN si AND NOT abs THEN 'supplement'
  WHEN si AND NOT refs THEN 'supplement_suspect' WHEN cor AND pages <= 4 AND NOT abs THEN 'corrigendum_or_erratum' WHEN toc AND pages <= 6 AND NOT abs THEN 'table_of_contents'
  WHEN lab AND pages <= 8 THEN 'editorial' WHEN edi AND pages <= 4 AND NOT refs THEN 'editorial' WHEN pages <= 2 AND abs AND NOT refs THEN 'abstract_only' ELSE 'article' END AS doc_type,
  (n < 200)::INT + len(list_filter({A.sql_list(I.ERROR_PAGES)}, lambda p: contains(probe, p))) + len(list_filter({A.sql_list(I.SUPPLEMENTS)}, lambda p: contains(probe, p)))
  + len(list_filter({A.sql_list(I.CORRIGENDA)}, lambda p: contains(probe, p))) + len(list_filter({A.sql_list(I.CONTENTS)}, lambda p: contains(probe, p)))
  + {' + '.join('(' + _h('probe', f'(?:^|{chr(92)}W){p}(?:{chr(92)}W|$)') + ')::INT' for p in I.EDITORIALS)} + si::INT
  + (round(own / greatest(1, own + greatest(0, fig - own)), 3) >= 0.75 AND own >= 5)::INT AS n_signals FROM sg)"""


@query(f"WITH {_TYPED} SELECT doc_id, doc_type, n_signals FROM ty")
def doc_typing(spark, d):
    rows = papers(spark, d).withColumn("title", I.text_title(F.col("first")))
    rows = rows.withColumn("e", I.evidence(F.col("first"), F.col("first"), F.col("title"), F.col("n")))
    return rows.select("doc_id", I.document_type(F.col("e.shown"), F.col("pages")).alias("doc_type"), F.size("e.signals").alias("n_signals"))


@query(f"""WITH {_FIRST} SELECT doc_id, CASE WHEN trim(meta) <> '' THEN trim(meta) ELSE left(trim(string_split(left(first, 500), chr(10))[1]), 150) END AS title, sha256(text) AS sha256, length(text) AS chars,
  left(trim(regexp_replace(first, '\\s+', ' ', 'g')), 400) AS preview,
  CASE WHEN doc_id % 12 = 0 THEN '10.1016/j.watres.2019.11502' WHEN doc_id % 12 = 11 THEN '10.1021/acs.est.0c01234' ELSE '' END AS doi FROM fp""")
def inventory_scan(spark, d):
    """What the inventory holds of a paper; two of the twelve first pages name a DOI."""
    first = F.col("first")
    return papers(spark, d).select(
        "doc_id", I.title_or_first_line(F.col("meta"), first).alias("title"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.length("text").alias("chars"),
        F.substring(F.trim(F.regexp_replace(first, r"\s+", " ")), 1, 400).alias("preview"), I.doi_of([F.lit(None).cast("string")], first).alias("doi"),
    )


_TOK = "list_filter(list_distinct(string_split(" + _NORM + ", ' ')), lambda w: w <> '' AND NOT list_contains(" + A.sql_list(I.TITLE_STOP_WORDS) + ", w))"


@query(f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN '<HTML> x' WHEN doc_id % 13 = 0 THEN 'PK' ELSE '%PDF-1.4' END AS head, doc_id % 5 AS pages, text, CASE WHEN doc_id % 3 = 0 THEN left(text, 60) ELSE 'The removal of xyzzy' END AS title FROM documents),
t AS (SELECT *, {_TOK.format('title')} AS w, {_TOK.format('left(text, 400)')} AS k FROM f)
SELECT doc_id, CASE WHEN NOT starts_with(head, '%PDF-') AND regexp_matches(lower(head), '<html|<!doctype') THEN 'html_page_not_pdf' WHEN NOT starts_with(head, '%PDF-') THEN 'bad_magic_bytes'
WHEN pages <= 0 THEN 'zero_pages' WHEN pages < 2 THEN 'too_few_pages(' || pages || ')' WHEN length(trim(text)) < 200 THEN 'insufficient_text(len=' || length(trim(text)) || ')'
WHEN regexp_matches(lower(text), 'please sign in|access denied|captcha') AND length(text) < 1500 THEN 'login_or_access_denied_page' WHEN length(text) < 500 THEN 'no_extractable_text'
WHEN {_h('left(text, 1500)', I.UNUSABLE_TITLE)} THEN 'supporting_info_or_corrigendum' WHEN len(w) > 0 AND len(list_intersect(w, k)) / len(w) < 0.2 THEN 'title_mismatch' ELSE '' END AS problem FROM t""")
def file_problems(spark, d):
    i = F.col("doc_id")
    head = F.when(i % 8 == 0, "<HTML> x").when(i % 13 == 0, "PK").otherwise("%PDF-1.4")
    title = F.when(i % 3 == 0, F.substring("text", 1, 60)).otherwise("The removal of xyzzy")
    return A.read(spark, d, "documents").select("doc_id", I.file_problem(head, i % 5, F.col("text"), title).alias("problem"))


# --- dedup in stages: every document, and near copies of every tenth

COPY = 10_000_000
_RECORDS = f"""r0 AS (SELECT doc_id AS id, doc_id, source, text FROM documents UNION ALL SELECT doc_id + {COPY}, doc_id, source, text || ' and some closing words' FROM documents WHERE doc_id % 10 = 0),
rec AS MATERIALIZED (SELECT id, CASE WHEN id % 23 = 0 THEN '{D.PRIOR}' ELSE source END AS source_group, CASE WHEN id % 19 = 0 THEN 'editorial' ELSE 'article' END AS doc_type,
  CASE WHEN id % 29 = 0 THEN 'broken' ELSE '' END AS open_error, sha256(text) AS sha256, id % 31 = 0 AS images_only, CASE WHEN id % 3 = 0 AND id < {COPY} THEN '10.1/' || (id % 600) ELSE '' END AS doi,
  left(text, 80) AS title, text, id % 2 = 0 AS has_references, source || '.pdf' AS file_name FROM r0)"""


def records(spark, d) -> DataFrame:
    docs = A.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    copies = docs.filter("id % 10 = 0").select((F.col("id") + COPY).alias("id"), "source", F.concat("text", F.lit(" and some closing words")).alias("text"))
    i = F.col("id")
    return docs.unionByName(copies).select(
        "id", F.when(i % 23 == 0, D.PRIOR).otherwise(F.col("source")).alias("source_group"), F.when(i % 19 == 0, "editorial").otherwise("article").alias("doc_type"),
        F.when(i % 29 == 0, "broken").otherwise("").alias("open_error"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), (i % 31 == 0).alias("images_only"),
        F.when((i % 3 == 0) & (i < COPY), F.concat(F.lit("10.1/"), (i % 600).cast("string"))).otherwise("").alias("doi"), F.substring("text", 1, 80).alias("title"), "text",
        (i % 2 == 0).alias("has_references"), F.concat("source", F.lit(".pdf")).alias("file_name"),
    )


_G = C.GRAM
_GRAMS = f"list_distinct(list_transform(range(0, length(t) - {_G} + 1, greatest({C.LEAST_STRIDE}, floor((length(t) - {_G}) / {C.MOST_GRAMS})::BIGINT + 1)), lambda i: substr(t, i + 1, {_G})))"
_BEST = "(doi <> '') DESC, has_references DESC, n DESC, lower(file_name) DESC, id"
_TN = _NORM
_STAGED = f"""{_RECORDS},
rn AS MATERIALIZED (SELECT *, length(text) AS n, regexp_replace(lower({A.decomposed_sql('text')}), '[^a-z0-9]+', '', 'g') AS t, {_TN.format('title')} AS tn FROM rec),
rb AS MATERIALIZED (SELECT *, source_group = '{D.PRIOR}' OR doc_type IN {tuple(I.REJECTED_TYPES)} OR open_error <> '' OR images_only OR n < {D.LEAST_TEXT} AS bad FROM rn),
s1 AS MATERIALIZED (SELECT *, first_value(id) OVER (PARTITION BY sha256 ORDER BY {_BEST}) AS sv FROM rb WHERE NOT bad),
s2 AS MATERIALIZED (SELECT *, CASE WHEN doi <> '' THEN first_value(id) OVER (PARTITION BY doi ORDER BY {_BEST}) END AS dv FROM s1 WHERE id = sv),
nd AS MATERIALIZED (SELECT * FROM s2 WHERE dv IS NULL OR dv = id),
ex AS MATERIALIZED (SELECT id, len(g) AS m, unnest(g) AS g FROM (SELECT id, {_GRAMS} AS g FROM nd WHERE length(t) >= {_G})),
nr AS (SELECT x.id AS a, y.id AS b FROM ex x JOIN ex y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id, x.m, y.m HAVING round(count(*) / (x.m + y.m - count(*)), 6) >= {C.NEAR}
  UNION SELECT x.id, y.id FROM nd x JOIN nd y ON x.t <> '' AND substr(x.t, 1, {C.FINGERPRINT}) = substr(y.t, 1, {C.FINGERPRINT}) AND x.id < y.id),
lp AS MATERIALIZED (SELECT a, b FROM nr JOIN nd x ON x.id = a JOIN nd y ON y.id = b WHERE NOT (x.doi <> '' AND y.doi <> '') AND least(length(x.tn), length(y.tn)) >= 15 AND (x.tn = y.tn OR
  (contains(CASE WHEN length(x.tn) <= length(y.tn) THEN y.tn ELSE x.tn END, CASE WHEN length(x.tn) <= length(y.tn) THEN x.tn ELSE y.tn END) AND least(length(x.tn), length(y.tn)) >= 0.6 * greatest(length(x.tn), length(y.tn))))),
lk AS MATERIALIZED (SELECT a, b FROM lp UNION SELECT b, a FROM lp),
rc AS (SELECT a AS id, a AS o FROM lk UNION SELECT rc.id, lk.b FROM rc JOIN lk ON lk.a = rc.o),
rt AS (SELECT id, min(o) AS root FROM rc GROUP BY id),
s3 AS MATERIALIZED (SELECT id, first_value(id) OVER (PARTITION BY root ORDER BY {_BEST}) AS tv FROM nd JOIN rt USING (id)),
st AS MATERIALIZED (SELECT r.id, CASE WHEN r.bad THEN 'rejected' WHEN sv <> r.id THEN 'sha256' WHEN dv <> r.id THEN 'doi' WHEN tv <> r.id THEN 'title_text' ELSE 'kept' END AS disposition,
  CASE WHEN sv <> r.id THEN sv WHEN dv <> r.id THEN dv WHEN tv <> r.id THEN tv END AS survivor, r.doi, tv FROM rb r LEFT JOIN s1 USING (id) LEFT JOIN (SELECT id, dv FROM s2) USING (id) LEFT JOIN s3 USING (id)),
sd AS MATERIALIZED (SELECT id, disposition, survivor, CASE WHEN disposition <> 'kept' THEN '' WHEN doi <> '' THEN 'unique_doi' WHEN tv IS NOT NULL THEN 'unique_title_text' ELSE 'unresolved' END AS resolution FROM st)"""


@query(f"WITH RECURSIVE {_STAGED} SELECT * FROM sd")
def dedup_stages(spark, d):
    return D.staged(records(spark, d))


@query(f"""WITH RECURSIVE {_STAGED} SELECT count(*) AS total, {', '.join(f"count(*) FILTER (WHERE {w}) AS {n}" for n, w in (
    ('rejected', "disposition = 'rejected'"), ('pool', "disposition <> 'rejected'"), ('sha_dup', "disposition = 'sha256'"), ('doi_dup', "disposition = 'doi'"),
    ('titletext_dup', "disposition = 'title_text'"), ('unresolved', "resolution = 'unresolved'"), ('final', "disposition = 'kept'")))} FROM sd""")
def dedup_accounting(spark, d):
    return D.accounting(D.staged(records(spark, d)))


_PAIRS = f"""{_RECORDS},
nt AS (SELECT id, regexp_replace(lower({A.decomposed_sql('text')}), '[^a-z0-9]+', '', 'g') AS t FROM rec),
gr AS (SELECT id, list_sort({_GRAMS}) AS g FROM nt WHERE length(t) >= {_G}),
rp AS (SELECT min(id) AS id, g FROM gr GROUP BY g),
ex AS (SELECT id, len(g) AS n, unnest(g) AS g FROM rp),
nb AS (SELECT x.id AS a, y.id AS b, x.n AS n, y.n AS m, count(*) AS shared FROM ex x JOIN ex y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2, 3, 4),
pairs AS (SELECT a, b, round(shared / (n + m - shared), 6) AS similarity FROM nb WHERE round(shared / (n + m - shared), 6) >= {C.NEAR})"""


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def near_dup_pairs(spark, d):
    return C.near_pairs(records(spark, d).withColumnRenamed("id", "doc_id"))


@query(f"""WITH RECURSIVE {_PAIRS}, lk AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS id, a AS other FROM lk UNION SELECT r.id, lk.b FROM reach r JOIN lk ON lk.a = r.other)
SELECT id, min(other) AS root FROM reach GROUP BY id""")
def dup_components(spark, d):
    return C.components(C.near_pairs(records(spark, d).withColumnRenamed("id", "doc_id")).select("a", "b"))


@query(f"""WITH {_RECORDS}, n AS (SELECT id, doc_type AS folder, regexp_replace(file_name, '[<>:"/\\\\|?*]', '_', 'g') AS f FROM rec),
k AS (SELECT *, row_number() OVER (PARTITION BY folder, lower(f) ORDER BY id) AS k FROM n)
SELECT id, folder, regexp_replace(f, '\\.pdf$', '') || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.pdf' AS file FROM k""")
def unique_file_names(spark, d):
    return D.unique_names(records(spark, d).withColumnRenamed("doc_type", "folder"))


# --- how papers are got, over candidates from parts

_PREFIX = ("10.1016/", "10.1021/", "10.1002/", "10.1007/", "10.1039/", "10.1111/", "10.9/")
_GET = f"""gt AS (SELECT id, title, journal, topic, year, cited, level, score, jrank, CASE WHEN id % 9 = 0 THEN '' ELSE {A.sql_list(_PREFIX)}[id % 7 + 1] || id END AS doi,
  CASE WHEN id % 5 = 0 THEN 'http://x/' || id ELSE '' END AS oa, CASE WHEN id % 4 = 0 THEN 'Elsevier BV' ELSE journal END AS publisher FROM sc)"""


def gettable(spark, d) -> DataFrame:
    i = F.col("id")
    prefix = F.element_at(F.array(*map(F.lit, _PREFIX)), (i % 7 + 1).cast("int"))
    return P.scored(spark, d).select(
        "id", "title", "journal", "topic", "year", "cited", "level", "score", "jrank", F.when(i % 9 == 0, "").otherwise(F.concat(prefix, i.cast("string"))).alias("doi"),
        F.when(i % 5 == 0, F.concat(F.lit("http://x/"), i.cast("string"))).otherwise("").alias("oa"), F.when(i % 4 == 0, "Elsevier BV").otherwise(F.col("journal")).alias("publisher"),
    )


_ACCESS = "CASE WHEN oa <> '' THEN 'open_access' WHEN jrank IN ('top', 'whitelist') OR contains(lower(publisher), 'elsevier') THEN 'institution_access_possible' WHEN doi <> '' THEN 'manual_required' ELSE 'unknown' END"
_ROUTE = "CASE " + " ".join(f"WHEN starts_with(doi, {A.q(p)}) THEN {A.q(n)}" for p, n in Q.ROUTES) + f" ELSE {A.q(Q.OTHER_ROUTE)} END"


@query(f"""WITH {P.CAND}, {_GET} SELECT id, {_ACCESS} AS access, CASE WHEN oa <> '' THEN oa WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE '' END AS url, {_ROUTE} AS route,
  CASE WHEN starts_with(doi, '10.1016/') THEN {A.q(Q.ROUTES[0][1])} WHEN {' OR '.join(f"starts_with(doi, '{p}')" for p in Q.PUBLISHER_PREFIXES)} THEN {A.q(Q.PUBLISHER_PAGE)} ELSE {A.q(Q.OTHER_ROUTE)} END AS publisher_route FROM gt""")
def access_routing(spark, d):
    doi = F.col("doi")
    rows = gettable(spark, d).withColumn("a", Q.access(F.col("oa"), F.col("publisher"), F.col("jrank"), doi))
    return rows.select("id", F.col("a.status").alias("access"), "a.url", Q.route(doi).alias("route"), Q.route(doi, True).alias("publisher_route"))


@query(f"""WITH {P.CAND}, {_GET} SELECT id, CASE WHEN id % 3 = 0 THEN 'u1' WHEN id % 4 = 0 THEN 'u2' WHEN id % 7 = 0 THEN NULL ELSE 'u0' END AS url,
  CASE WHEN id % 6 = 1 THEN 'content' WHEN id % 5 = 1 THEN 'unpaywall' ELSE 'manual' END AS channel,
  concat_ws(';', CASE WHEN id % 6 <> 1 AND id % 2 = 0 THEN 'content:not_pdf_magic' END, CASE WHEN id % 5 <> 1 THEN 'unpaywall:title_mismatch' END) AS reasons FROM gt""")
def channel_fallback(spark, d):
    i = F.col("id")
    spot = lambda v, u, c: F.when(c, F.struct(F.lit(v).alias("version"), F.lit(u).alias("url")))
    places = F.array_compact(F.array(spot("submittedVersion", "u0", i % 7 != 0), spot("acceptedVersion", "u2", i % 4 == 0), spot("publishedVersion", "", F.lit(True)), spot("publishedVersion", "u1", i % 3 == 0)))
    content = F.when(i % 6 == 1, "").when(i % 2 == 0, "not_pdf_magic")
    found = Q.first_channel([("content", content), ("unpaywall", F.when(i % 5 == 1, "").otherwise("title_mismatch"))])
    return gettable(spark, d).select("id", Q.best_location(places).alias("url"), found.alias("f")).select("id", "url", "f.channel", "f.reasons")


@query(f"WITH {P.CAND}, {_GET} SELECT id, score FROM (SELECT *, {_ACCESS} AS access FROM gt) WHERE level = 'A' AND access <> 'open_access' ORDER BY score DESC, id LIMIT 40")
def download_list(spark, d):
    """The best forty of level A that aren't open: a top-k report."""
    rows = gettable(spark, d).withColumn("access", Q.access(F.col("oa"), F.col("publisher"), F.col("jrank"), F.col("doi"))["status"])
    return Q.wanted_first(rows).select("id", "score")


@query(f"WITH {P.CAND} SELECT id, cited, row_number() OVER (ORDER BY cited DESC, id) AS place FROM cd ORDER BY cited DESC, id LIMIT 30")
def hard_negative_quota(spark, d):
    return Q.hard_negatives(P.candidates(spark, d).select("id", "cited"), 30)


@query(f"WITH {P.CAND} SELECT id, CASE id % 4 WHEN 0 THEN id / 8.0 ELSE 0 END AS score FROM cd")
def notes_score(spark, d):
    i = F.col("id")
    notes = F.when(i % 4 == 0, F.concat(F.lit("score="), (i / 8.0).cast("string"), F.lit("; cited"))).when(i % 4 == 1, "nothing").when(i % 4 == 2, "score=abc;")
    return P.candidates(spark, d).select("id", Q.noted_score(notes).alias("score"))


def _line(tag: str, c: str) -> str:
    return f"CASE WHEN {c} <> '' THEN '{tag}' || {c} END"


_URL = "CASE WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE '' END"


@query(f"""WITH {P.CAND}, {_GET}, b AS (SELECT id, title, year::VARCHAR AS year, journal, doi, {_URL} AS url, topic, level || ' | ' || {_ROUTE} AS note, level, year AS y FROM gt)
SELECT id, concat_ws(chr(10), 'TY  - JOUR', 'TI  - ' || title, {_line('PY  - ', 'year')}, {_line('JO  - ', 'journal')}, {_line('T2  - ', 'journal')}, {_line('DO  - ', 'doi')}, {_line('UR  - ', 'url')},
  {_line('KW  - ', 'topic')}, 'N1  - Priority ' || note, 'ER  - ') AS ris,
concat_ws(chr(10), '%0 Journal Article', '%T ' || title, {_line('%D ', 'year')}, {_line('%J ', 'journal')}, {_line('%R ', 'doi')}, {_line('%U ', 'url')}, {_line('%K ', 'topic')}, '%1 Priority ' || note) AS enw,
row_number() OVER (ORDER BY level, topic, y, id) AS place FROM b""")
def bibliography_lines(spark, d):
    rows = gettable(spark, d).withColumnRenamed("level", "priority").withColumn("route", Q.route(F.col("doi"))).withColumn("url", F.lit(""))
    return Q.bibliography(rows).join(Q.export_order(rows).select("id", "place"), "id")


@query("""WITH d AS (SELECT doc_id, 'See 10.1016/j.x.' || doc_id || ', https://doi.org/10.1021/ABC' || (doc_id % 7) || ') and 10.1016/J.X.' || doc_id || '.' AS t FROM documents)
SELECT doc_id, '10.1016/j.x.' || doc_id || ',10.1021/abc' || (doc_id % 7) AS dois, '10.1016/j.x.' || doc_id AS first_doi FROM d""")
def doi_find(spark, d):
    """All DOIs of a text, each once, and a DOI from a raw field."""
    i = F.col("doc_id").cast("string")
    t = F.concat(F.lit("See 10.1016/j.x."), i, F.lit(", https://doi.org/10.1021/ABC"), (F.col("doc_id") % 7).cast("string"), F.lit(") and 10.1016/J.X."), i, F.lit("."))
    rows = A.read(spark, d, "documents").select("doc_id", t.alias("t"), F.concat(F.lit(" DOI: https://doi.org/10.1016/J.X."), i, F.lit(".,;")).alias("raw"))
    return rows.select("doc_id", F.array_join(T.dois(F.col("t")), ",").alias("dois"), T.doi_normal(F.regexp_replace("raw", "^ DOI: ", "")).alias("first_doi"))
