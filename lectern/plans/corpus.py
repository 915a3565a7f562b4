"""Queries over corpus maintenance: identifiers, titles, duplicates, selection, triage, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import payloads as Y
from lectern.functions import text as T
from lectern.operators import corpus as C

from . import adapters as A
from .registry import registry

QUERIES, ORACLES, query = registry()

_DOI_FORMS = (
    ("https://doi.org/10.1016/J.Watres.", ""), ("doi: 10.1016/J.WATRES.", ".,;"), ("DOI 10.1016/j.watres.", ""), (" 10.1016/j.watres.", " getrights"),
    ("10.1016/j.watres.", "http://x"), ("http://dx.doi.org/10.1016/j.watres.", ")"), ("not a doi ", ""),
)


@query(f"SELECT doc_id, CASE WHEN doc_id % 8 < 6 THEN '10.1016/j.watres.' || doc_id ELSE '' END AS doi FROM documents")
def doi_normalize(spark, d):
    """Each document's identifier in one of the forms it's met in, or none; the oracle knows the bare one."""
    form = F.col("doc_id") % 8
    raw = F.lit(None).cast("string")
    for i, (before, after) in enumerate(_DOI_FORMS):
        raw = F.when(form == i, F.concat(F.lit(before), "doc_id", F.lit(after))).otherwise(raw)
    return A.read(spark, d, "documents").select("doc_id", T.doi_normal(raw).alias("doi"))


# --- candidates from parts

_TOP, _LISTED = ("brand#1", "brand#2"), ("brand#3",)
_JR = "CASE WHEN contains(lower(p_brand), 'brand#1') OR contains(lower(p_brand), 'brand#2') THEN 'top' WHEN contains(lower(p_brand), 'brand#3') THEN 'whitelist' ELSE '' END"
CAND = f"""cd AS (SELECT p_partkey AS id, p_name AS title, p_brand AS journal, p_type AS topic, p_size * 20 AS cited, (1980 + p_partkey % 47)::INT AS year, p_partkey % 4 = 0 AS review, 'author' || (p_partkey % 50) AS author, {_JR} AS jrank FROM part),
pr AS (SELECT *, CASE WHEN topic = 'hard_negative' THEN 'C' WHEN cited >= 800 OR (cited >= 400 AND jrank = 'top') OR (review AND cited >= 300) OR (year >= 2025 AND cited >= 80 AND jrank = 'top') THEN 'A'
WHEN cited >= 150 OR (review AND cited >= 60) OR (year >= 2023 AND cited >= 20) OR (cited >= 60 AND jrank IN ('top', 'whitelist')) OR cited >= 30 THEN 'B' ELSE '' END AS level FROM cd),
sc AS (SELECT *, round((log10(cited + 1) + CASE WHEN year >= 2023 THEN CASE WHEN cited >= 20 THEN 0.6 ELSE 0.2 END ELSE 0 END) * 3 + CASE jrank WHEN 'top' THEN 3 WHEN 'whitelist' THEN 1.5 ELSE 0 END + CASE level WHEN 'A' THEN 2 WHEN 'B' THEN 1 ELSE 0.5 END, 6) AS score
FROM pr WHERE (year = 0 OR year >= 1990) AND level <> '')"""


def candidates(spark, d) -> DataFrame:
    low = F.lower("p_brand")
    has = lambda xs: F.exists(F.array(*map(F.lit, xs)), lambda x: low.contains(x))
    k = F.col("p_partkey")
    return A.read(spark, d, "part").select(
        k.alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("journal"), F.col("p_type").alias("topic"), (F.col("p_size") * 20).alias("cited"), (1980 + k % 47).cast("int").alias("year"),
        (k % 4 == 0).alias("review"), F.concat(F.lit("author"), k % 50).alias("author"), F.when(has(_TOP), "top").when(has(_LISTED), "whitelist").otherwise("").alias("jrank"),
    )


def scored(spark, d) -> DataFrame:
    rows = candidates(spark, d).withColumn("level", C.priority(*(F.col(x) for x in ("cited", "year", "jrank", "review", "topic"))))
    rows = rows.filter((F.col("year").isNull() | (F.col("year") == 0) | (F.col("year") >= C.MIN_YEAR)) & (F.col("level") != ""))
    return rows.withColumn("score", F.round(C.composite(C.citation_score(F.col("cited"), F.col("year")), F.col("jrank"), F.col("level")), 6))


@query(f"WITH {CAND} SELECT id, level, score FROM sc")
def candidate_score(spark, d):
    return scored(spark, d).select("id", "level", "score")


_WHY = """CASE WHEN topic = 'hard_negative' THEN 'Hard negative: topic-similar but answers a different question' WHEN cited >= 800 THEN 'Landmark classic (' || cited || ' citations), representative work'
WHEN cited >= 400 AND jrank = 'top' THEN 'High-cited (' || cited || ') in core journal (' || journal || ')' WHEN review AND cited >= 300 THEN 'Key review (' || cited || ' citations) in ' || journal
WHEN year >= 2025 AND cited >= 80 AND jrank = 'top' THEN 'Important recent (' || year || ') work in ' || journal || ' (' || cited || ' citations)' WHEN cited >= 150 THEN 'Established work (' || cited || ' citations), supplements coverage'
WHEN review AND cited >= 60 THEN 'Review in ' || journal || ', broadens topic coverage' WHEN year >= 2023 AND cited >= 20 THEN 'Recent (' || year || ') work (' || cited || ' citations)'
WHEN cited >= 60 AND jrank IN ('top', 'whitelist') THEN 'Moderately cited (' || cited || ') in ' || journal || ', diversifies conditions' WHEN cited >= 30 THEN 'Moderately cited (' || cited || ') work, diversifies materials/routes' ELSE '' END"""


@query(f"""WITH {CAND} SELECT id, {_WHY} AS reason, CASE WHEN review OR regexp_matches(CASE WHEN id % 6 = 0 THEN 'A systematic review of ' || title ELSE title END, {A.q(C.REVIEW_TITLE)}) THEN 'review' ELSE 'original_research' END AS paper_type FROM cd""")
def priority_reasons(spark, d):
    c = lambda *names: (F.col(x) for x in names)
    title = F.when(F.col("id") % 6 == 0, F.concat(F.lit("A systematic review of "), "title")).otherwise(F.col("title"))
    kind = C.paper_type(F.when(F.col("review"), "Review"), title)
    return candidates(spark, d).select("id", C.priority_reason(*c("cited", "year", "jrank", "review", "topic", "journal")).alias("reason"), kind.alias("paper_type"))


@query(f"WITH {CAND} SELECT jrank, level, count(*) AS n FROM pr GROUP BY 1, 2")
def journal_rank(spark, d):
    rows = candidates(spark, d).withColumn("level", C.priority(*(F.col(x) for x in ("cited", "year", "jrank", "review", "topic"))))
    return rows.groupBy("jrank", "level").agg(F.count("*").alias("n"))


@query()
def quota_select(spark, d):
    return C.quota_selection(scored(spark, d).select("id", "topic", "author", "journal", "year", "review", "level", "score"), 20)


@query()
def trim_select(spark, d):
    """The selection itself, a fold over each topic: held against a plain version in the tests."""
    return C.trim_selection(scored(spark, d).select("id", "topic", "author", "journal", "year", "review", "score"), 20)


@query(f"""WITH {CAND}, c AS (SELECT id, CASE WHEN id % 17 = 0 THEN 'hard_negative' ELSE topic END AS topic, score, cited FROM sc),
m AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY topic) AS n FROM c WHERE id % 3 = 0 AND topic <> 'hard_negative'),
l AS (SELECT id, CASE WHEN r <= round_even(n * {C.A_SHARE}, 0) THEN 'A' ELSE 'B' END AS list FROM m),
h AS (SELECT id FROM c WHERE topic = 'hard_negative' AND id % 7 <> 0 ORDER BY cited DESC, id LIMIT 12),
o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS r FROM c WHERE topic <> 'hard_negative' AND id % 7 <> 0 AND id NOT IN (SELECT id FROM l)),
v AS (SELECT id FROM o WHERE r <= {C.RESERVE_PER_TOPIC} ORDER BY score DESC, id LIMIT {C.RESERVE}),
w AS (SELECT c.id, topic, coalesce(l.list, CASE WHEN c.id IN (SELECT id FROM h) THEN 'C' WHEN c.id IN (SELECT id FROM v) THEN 'reserve' END, 'rejected') AS list FROM c LEFT JOIN l USING (id))
SELECT id, list, CASE WHEN list <> 'rejected' THEN '' WHEN id % 7 = 0 THEN 'duplicate_of_existing_corpus' WHEN topic = 'hard_negative' THEN 'hn_quota_exceeded' ELSE 'quota_exceeded' END AS reason FROM w""")
def trim_reserve(spark, d):
    """Lists and reasons, given a selection (every third candidate) and what is there already (every seventh)."""
    rows = scored(spark, d).select("id", F.when(F.col("id") % 17 == 0, "hard_negative").otherwise(F.col("topic")).alias("topic"), "score", "cited")
    return C.trimmed(rows, rows.filter("id % 3 = 0 and topic <> 'hard_negative'"), rows.filter("id % 7 = 0"), 12)


@query(f"WITH {CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS n FROM sc) SELECT id, topic, score FROM r WHERE n <= 6 ORDER BY score DESC, id LIMIT 40")
def report_topn(spark, d):
    """The reserve: a top-k report, six of a topic and forty in all."""
    w = Window.partitionBy("topic").orderBy(F.desc("score"), "id")
    rows = scored(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 6")
    return rows.orderBy(F.desc("score"), "id").limit(40).select("id", "topic", "score")


@query(f"WITH {CAND} SELECT id, printf('C%04d', row_number() OVER (ORDER BY topic, score DESC, id)) AS candidate_id FROM sc")
def id_allocation(spark, d):
    rows = C.numbered(scored(spark, d).select("id", "topic", "score"), [F.col("topic"), F.desc("score"), F.col("id")])
    return rows.select("id", F.format_string("C%04d", F.col("n")).alias("candidate_id"))


_RULES = [("metal", "(?i)steel|brass|copper|nickel|tin"), ("plated", "(?i)plated"), ("large", "(?i)large|economy"), ("r", "(?i)^r")]


@query(f"WITH {CAND} SELECT topic, CASE {' '.join(f'WHEN regexp_matches(topic, {A.q(p)}) THEN {A.q(n)}' for n, p in _RULES)} ELSE 'other' END AS cluster, CASE WHEN year = 0 THEN 'unknown' WHEN year < 2000 THEN 'before 2000' WHEN year < 2010 THEN '2000-2009' WHEN year < 2020 THEN '2010-2019' ELSE '2020 on' END AS bucket, count(*) AS n FROM cd GROUP BY 1, 2, 3")
def topic_classify(spark, d):
    return candidates(spark, d).groupBy("topic", C.first_rule(F.col("topic"), _RULES).alias("cluster"), T.year_bucket(F.col("year")).alias("bucket")).agg(F.count("*").alias("n"))


_DOI = "'10.1/' || (id % 900)"


@query(f"WITH {CAND}, a AS (SELECT {_DOI} AS doi, id, 1 AS o FROM cd WHERE id % 2 = 0), b AS (SELECT {_DOI} AS doi, id, 2 AS o FROM cd WHERE id % 3 = 0), u AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY o, id) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT doi, id, CASE o WHEN 1 THEN 'main' ELSE 'supplement' END AS origin FROM u WHERE n = 1 AND doi NOT IN (SELECT {_DOI} FROM cd WHERE id % 11 = 0)")
def manifest_merge(spark, d):
    """Main list and supplement, the first row of a DOI kept, what is done already left out."""
    rows = candidates(spark, d).select(F.concat(F.lit("10.1/"), F.col("id") % 900).alias("doi"), "id")
    both = rows.filter("id % 2 = 0").withColumn("origin", F.lit("main")).unionByName(rows.filter("id % 3 = 0").withColumn("origin", F.lit("supplement")))
    return C.keep_first(both, ["doi"], [F.col("origin"), F.col("id")]).join(rows.filter("id % 11 = 0").select("doi"), "doi", "left_anti")


@query(f"WITH {CAND}, k AS (SELECT *, {_DOI} AS doi, 's' || (id % 700) AS sha FROM cd), co AS (SELECT doi, sha FROM k WHERE id % 6 = 0) SELECT id, CASE WHEN id % 13 = 0 THEN 'rejected' WHEN sha IN (SELECT sha FROM co) THEN 'duplicate_sha' WHEN doi IN (SELECT doi FROM co) THEN 'duplicate_doi' WHEN doi IN (SELECT doi FROM k WHERE id % 5 = 0) THEN 'matched' ELSE 'untracked' END AS bucket FROM k")
def triage_buckets(spark, d):
    rows = candidates(spark, d).select("id", F.concat(F.lit("10.1/"), F.col("id") % 900).alias("doi"), F.concat(F.lit("s"), F.col("id") % 700).alias("sha"), (F.col("id") % 13 != 0).alias("ok"))
    return C.triage(rows, rows.filter("id % 6 = 0"), rows.filter("id % 5 = 0"))


_TN = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH {CAND}, t AS (SELECT id, journal, {_TN} AS x, lead({_TN}) OVER (PARTITION BY journal ORDER BY id) AS y FROM cd)
SELECT id, least(length(x), length(y)) >= 15 AND (x = y OR (contains(CASE WHEN length(x) <= length(y) THEN y ELSE x END, CASE WHEN length(x) <= length(y) THEN x ELSE y END) AND least(length(x), length(y)) >= 0.6 * greatest(length(x), length(y)))) AS same,
round(len(list_intersect(list_distinct(string_split(x, ' ')), list_distinct(string_split(y, ' ')))) / len(list_distinct(list_concat(string_split(x, ' '), string_split(y, ' ')))), 6) AS similarity FROM t WHERE y IS NOT NULL""")
def title_match(spark, d):
    rows = candidates(spark, d).withColumn("other", F.lead("title").over(Window.partitionBy("journal").orderBy("id"))).filter("other is not null")
    x, y = F.col("title"), F.col("other")
    return rows.select("id", T.titles_match(x, y).alias("same"), F.round(T.jaccard(T.content_tokens(x), T.content_tokens(y), 0.0), 6).alias("similarity"))


_TK = f"list_filter(list_distinct(string_split({_TN}, ' ')), lambda x: x <> '')"


@query(f"""WITH {CAND}, t AS (SELECT id, {_TK} AS k FROM cd),
s AS (SELECT x.id, y.id AS other, len(list_intersect(x.k, y.k)) / len(list_distinct(list_concat(x.k, y.k))) AS s FROM t x JOIN t y ON x.id <> y.id AND len(list_intersect(x.k, y.k)) > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS n FROM s)
SELECT t.id, b.other AS best_id, round(coalesce(b.s, 0), 6) AS similarity, coalesce(b.s, 0) >= {C.FLAGGED} AS flagged, coalesce(b.s, 0) >= {C.CONFIRMED} AS confirmed FROM t LEFT JOIN b ON b.id = t.id AND b.n = 1""")
def title_best_match(spark, d):
    """Of all other titles the most similar one, with the two thresholds."""
    return C.best_titles(candidates(spark, d))


_TITLES = (
    ("Occurrence of PFAS in river water", ""), ("Removal of PFAS from wastewater", "hn_answers_same_question(is a treatment paper)"),
    ("Soil burden of PFAS in water", "hn_off_topic(soil/epidemiology/non-water)"), ("A new catalyst", "hn_off_topic(not water-related)"),
    ("Ozone in drinking water", "hn_not_occurrence_type"), ("Fate of drugs in sewage treatment plants", ""),
)


@query(f"SELECT p_partkey AS id, {A.sql_list(v for _, v in _TITLES)}[p_partkey % {len(_TITLES)} + 1] AS verdict FROM part")
def hard_negative_verdict(spark, d):
    """Every part as a candidate whose title is about one of six things; the oracle knows which."""
    titles = F.array(*(F.lit(t) for t, _ in _TITLES))
    title = F.concat(F.element_at(titles, (F.col("p_partkey") % len(_TITLES) + 1).cast("int")), F.lit(" near "), "p_name")
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), C.hard_negative(title).alias("verdict"))


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS survivor FROM documents GROUP BY 1")
def exact_dedup(spark, d):
    return C.exact_groups(A.read(spark, d, "documents"))


@query(f"""WITH RECURSIVE nt AS (SELECT doc_id, regexp_replace(lower({A.decomposed_sql("coalesce(text, '')")}), '[^a-z0-9]+', '', 'g') AS t FROM documents),
ex AS (SELECT doc_id AS id, len(g) AS n, unnest(g) AS g FROM (SELECT doc_id, list_distinct(list_transform(range(0, length(t) - {C.GRAM} + 1, greatest({C.LEAST_STRIDE}, floor((length(t) - {C.GRAM}) / {C.MOST_GRAMS})::BIGINT + 1)), lambda i: substr(t, i + 1, {C.GRAM}))) AS g FROM nt WHERE length(t) >= {C.GRAM})),
lk AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM ex x JOIN ex y ON x.g = y.g AND x.id <> y.id GROUP BY x.id, y.id, x.n, y.n HAVING round(count(*) / (x.n + y.n - count(*)), 6) >= {C.NEAR}
UNION SELECT x.doc_id, y.doc_id FROM nt x JOIN nt y ON x.t <> '' AND x.t = y.t AND x.doc_id <> y.doc_id),
reach AS (SELECT doc_id AS id, doc_id AS other FROM nt UNION SELECT r.id, lk.b FROM reach r JOIN lk ON lk.a = r.other)
SELECT id AS doc_id, min(other) AS root FROM reach GROUP BY id""")
def dup_members(spark, d):
    """Every document with its root; dup_components has the linked representatives only."""
    return C.duplicate_roots(A.read(spark, d, "documents"))


@query("SELECT a.source AS source_a, b.source AS source_b, count(*) AS n FROM (SELECT DISTINCT source, sha256(text) AS h FROM documents) a JOIN (SELECT DISTINCT source, sha256(text) AS h FROM documents) b ON a.h = b.h AND a.source < b.source GROUP BY 1, 2")
def overlap_matrix(spark, d):
    """Of each two sources how many texts both hold; a text's sources are few, so its pairs are made from one array."""
    per = A.read(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.array_sort(F.collect_set("source")).alias("s")).filter(F.size("s") > 1)
    pairs = per.select(F.posexplode("s").alias("i", "source_a"), "s").select("source_a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("source_b"))
    return pairs.groupBy("source_a", "source_b").agg(F.count("*").alias("n"))


_HALF = "('0x' || substr(md5(doc_id || ':' || sha256(text)), {0}, 15))::BIGINT::HUGEINT"


@query(f"SELECT count(*) || '-' || sum({_HALF.format(1)}) || '-' || sum({_HALF.format(16)}) AS version, count(*) AS n FROM documents")
def version_hash(spark, d):
    """The collection version: sums of two hashes a row, so that no order and no list of rows is needed."""
    h = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2(F.col("text").cast("binary"), 256)).cast("binary"))
    half = lambda a: F.sum(F.conv(F.substring(h, a, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    rows = A.read(spark, d, "documents")
    return rows.agg(F.concat_ws("-", F.count("*").cast("string"), half(1), half(16)).alias("version"), F.count("*").alias("n"))


@query("""SELECT page_id, contains(html, '<article') AS has_sections, (length(html) - length(replace(html, '<p>', ''))) // 3 AS paragraphs,
contains(html, '<h1') OR contains(html, '<h2') AS has_abstract, NOT contains(html, '<body') AS core_only,
left(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), 80) AS first_title FROM pages""")
def html_signals(spark, d):
    """Marks of structure in web pages."""
    return A.read(spark, d, "pages").select("page_id", Y.markup_signals(F.col("html"), Y.HTML).alias("s")).select("page_id", "s.*")


@query(f"""SELECT page_id, CASE WHEN page_id % 11 = 5 THEN NULL WHEN page_id % 3 = 0 THEN 'abstract' ELSE 'article' END AS kind,
CASE WHEN page_id % 11 = 5 THEN '' ELSE left(url, 80) END AS title, page_id % 11 <> 5 AND page_id % 3 = 0 AS has_abstract,
CASE WHEN page_id % 11 <> 5 AND page_id % 2 = 0 THEN '1' END AS open_access,
CASE WHEN page_id % 11 = 5 THEN '' WHEN page_id % 2 = 0 THEN 'openaccess,entitled' ELSE 'entitled' END AS access_fields,
CASE WHEN page_id % 11 <> 5 AND page_id % 3 <> 0 THEN length(html) END AS text_length,
CASE WHEN page_id % 11 <> 5 AND page_id % 3 <> 0 THEN contains(html, '<article') END AS has_sections,
CASE WHEN page_id % 11 <> 5 AND page_id % 3 <> 0 THEN (length(html) - length(replace(html, '<p>', ''))) // 3 END AS paragraphs FROM pages""")
def json_answers(spark, d):
    """Kinds and fields of a service's answers, made of the pages: every third an abstract, every eleventh cut off."""
    i = F.col("page_id")
    core = F.struct(
        F.col("url").alias("dc:title"), F.when(i % 3 == 0, "words").alias("dc:description"), F.when(i % 2 == 0, "1").alias("openaccess"), F.lit("yes").alias("entitled")
    )
    abstract = F.to_json(F.struct(F.struct(core.alias("coredata")).alias(Y.ABSTRACT)))
    article = F.to_json(F.struct(F.struct(core.alias("coredata"), F.col("html").alias("originalText")).alias(Y.ARTICLE)))
    payload = F.when(i % 11 == 5, F.lit('{"full-text')).when(i % 3 == 0, abstract).otherwise(article)
    rows = A.read(spark, d, "pages").select("page_id", Y.json_signals(payload, Y.HTML).alias("s")).select("page_id", "s.*")
    return rows.withColumn("access_fields", F.array_join("access_fields", ","))


_CLASSES = [("correction", "(?i)erratum|corrigendum"), ("login", "(?i)sign in|captcha"), ("listing", "(?i)<li>(?s:.*)<li>(?s:.*)<li>"), ("article", "(?i)<article")]


@query(f"SELECT page_id, CASE {' '.join(f'WHEN regexp_matches(html, {A.q(p)}) THEN {A.q(n)}' for n, p in _CLASSES)} ELSE 'other' END AS doc_type FROM pages")
def doc_classify(spark, d):
    return A.read(spark, d, "pages").select("page_id", C.first_rule(F.col("html"), _CLASSES).alias("doc_type"))


@query(rf"""SELECT doc_id, trim(regexp_replace(lower({A.decomposed_sql("left_text")}), '[^a-z0-9]+', ' ', 'g')) AS title_norm,
sha256(substr(regexp_replace(lower({A.decomposed_sql("text")}), '[^a-z0-9]+', '', 'g'), 1, 4000)) AS fingerprint,
CASE WHEN sn = '' THEN 'unnamed.pdf' ELSE sn END AS file_name FROM (SELECT *, string_split(text, chr(10))[1] AS left_text,
    regexp_replace(regexp_replace(source || '/' || doc_id || '?.pdf', '[<>:"/\\|?*]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS sn FROM documents)""")
def text_normalizers(spark, d):
    first = F.get(F.split("text", "\n"), 0)
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("?.pdf"))
    # the fingerprint of a body is a hash of its first 4000 normal characters; that prefix is the definition
    return A.read(spark, d, "documents").select("doc_id", T.title_norm(first).alias("title_norm"), F.sha2(F.substring(T.text_norm(F.col("text")), 1, 4000).cast("binary"), 256).alias("fingerprint"), T.sanitized(name).alias("file_name"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events")
def usage_and_notes(spark, d):
    keys = F.json_object_keys("props")
    return A.read(spark, d, "events").select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), F.get(keys, 0)).alias("first_value"), F.size(keys).cast("long").alias("n_keys"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 < 3 THEN p_name ELSE '' END AS first_author, CASE WHEN p_partkey % 5 IN (0, 3) THEN p_brand ELSE '' END AS journal FROM part""")
def nested_fields(spark, d):
    """Every part as a record of a catalogue: authors and journal nested, empty, null or missing."""
    k = F.col("p_partkey") % 5
    one = F.array(F.struct(F.struct(F.col("p_name").alias("display_name")).alias("author")))
    both = F.to_json(F.struct(one.alias("authorships"), F.struct(F.col("p_brand").alias("name")).alias("host")))
    author = F.to_json(F.struct(one.alias("authorships")))
    empty = F.to_json(F.struct(F.slice(one, 1, 0).alias("authorships"), F.struct(F.col("p_brand").alias("name")).alias("host")))
    body = F.when(k == 0, both).when(k == 1, author).when(k == 2, F.concat(F.rtrim(author, F.lit("}")), F.lit('}}], "host": null}'))).when(k == 3, empty).otherwise("{}")
    rows = A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), C.work_fields(body).alias("w"))
    return rows.select("id", "w.first_author", "w.journal")


@query("""WITH t AS (SELECT doc_id, 'sm' || translate(doc_id::VARCHAR, '0123456789', 'abcdefghij') AS name, doc_id % 5 AS k FROM documents)
SELECT doc_id, CASE WHEN k < 3 THEN name ELSE '' END AS author, CASE k WHEN 0 THEN 'publisher_version' WHEN 1 THEN 'accepted_manuscript' WHEN 4 THEN 'accepted_manuscript' ELSE 'unknown' END AS version,
k = 2 AS has_references, CASE k WHEN 0 THEN 'We did ' || doc_id || '. ' WHEN 1 THEN 'no heading here ' || doc_id WHEN 2 THEN 'Text ' || doc_id || '. ' WHEN 3 THEN '' ELSE 'Postprint at mdpi.com' END AS abstract FROM t""")
def title_author_text(spark, d):
    """First pages of five kinds, one for each document, with the name and a number of the document in them."""
    k, n = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    name = F.concat(F.lit("Sm"), F.translate(n, "0123456789", "abcdefghij"))
    pick = lambda *cases: F.element_at(F.array(*(F.lit(x) if x is None or isinstance(x, str) else x for x in cases)), (k + 1).cast("int"))
    authors = pick(F.concat(name, F.lit(" J., Doe A.")), F.concat(F.lit("John "), name, F.lit(" and Ann Lee")), F.concat(name, F.lit("2, K.")), None, "")
    first = pick(
        F.concat(F.lit("Contents lists available at ScienceDirect. Abstract: We did "), n, F.lit(". Keywords: a, b")), F.concat(F.lit("no heading here "), n),
        F.concat(F.lit("A B S T R A C T\nText "), n, F.lit(". 1. Introduction more")), None, "Postprint at mdpi.com",
    )
    whole = pick("x", "an accepted manuscript", "y references z", None, "z")
    rows = A.read(spark, d, "documents").select("doc_id", authors.alias("authors"), first.alias("first"), whole.alias("whole"))
    author, abstract = T.first_author(F.col("authors")), T.abstract_of(F.col("first"))
    return rows.select("doc_id", author.alias("author"), T.version_type(F.col("first"), F.col("whole")).alias("version"), T.has_references(F.col("whole")).alias("has_references"), abstract.alias("abstract"))
