"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table.

``queries`` and ``oracle_sql`` are what ``__spark_entry__.py`` adds; an operator that SQL cannot express has no oracle
and is held against a brute-force version in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, codes, impacts, minhash, mixing, nearest, packing, quality, runs, secrets, substrings, toxicity, warc
from . import oracles
from .shared import WORD, fresh_path, read, stored, unkeyed

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boilerplate.deduplicated(read(spark, sf_dir, "documents"))
    text = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return rows.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), text.alias("kept_sha256"))


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.deduplicated(read(spark, sf_dir, "documents"), keep_text=False)
    return rows.select(unkeyed().alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(read(spark, sf_dir, "documents"))
    return rows.select(unkeyed().alias("doc_id"), "size", "source_size", "target", "taken")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.near_duplicates(read(spark, sf_dir, "documents"))
    same = unkeyed("component").eqNullSafe(unkeyed())
    return rows.select(unkeyed().alias("doc_id"), F.col("n").alias("n_shingles"), unkeyed("component").alias("component_id"), same.alias("kept"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    return warc.resolved_revisits(stored(warc.read_archives(spark, path).drop("html"), "headers"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scorer = toxicity.train(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    rows = toxicity.scores(docs, scorer)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("spans")
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", spans)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(read(spark, sf_dir, "embeddings")).drop("label")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; texts whose doc_id's CRC-32 is a multiple of ten get a tail of repeated words, as the contract plants it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when((h % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("ws")).withColumn("n", F.size("ws"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.array_repeat(F.slice("ws", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    planted = F.concat(F.slice("ws", 1, F.col("a")), F.slice(F.flatten(tail), 1, F.col("n") - F.col("a")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.periodic_runs(with_repeats(read(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    text = F.array_join(lines, "")
    rows = rows.withColumn("best", runs.strongest())
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{x}").alias(x) for x in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.top(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_best_two_fit": op2_best_two_fit,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_mix_sources": op5_mix_sources,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_secret_scan": op8_secret_scan,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_exact_top_k": op13_exact_top_k,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": """
        WITH s AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
        l AS (SELECT doc_id, source, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM s),
        b AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM l),
        k AS (SELECT bare, min({'d': doc_id, 'a': pos}) AS one FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 10),
        m AS (SELECT b.*, k.one IS NOT NULL AND k.one <> {'d': b.doc_id, 'a': b.pos} AS gone FROM b LEFT JOIN k USING (bare)),
        t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
                     coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id)
        SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN t USING (doc_id)
    """,
    "op3_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w),
        h AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h FROM p),
        d AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM h WHERE h IN (SELECT h FROM d)),
        l AS (SELECT doc_id, list(j) AS js FROM g GROUP BY doc_id),
        e AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS x FROM w),
        k AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.j) AS kept FROM e ANTI JOIN g ON g.doc_id = e.doc_id AND g.j = e.j GROUP BY e.doc_id)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(len(js), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
    "op5_mix_sources": r"""
        WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                          md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')), 'mix-1')) AS key FROM documents),
        b AS (SELECT source, sum(size) AS n FROM s GROUP BY source),
        w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM b),
        o AS (SELECT *, coalesce(sum(3 * n) OVER q, 0) AS caps, coalesce(sum(weight) OVER q, 0) AS before, sum(n) OVER () AS total, sum(weight) OVER () AS weights FROM w
              WINDOW q AS (ORDER BY 3 * n / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        v AS (SELECT *, (total - caps)::DOUBLE / (weights - before)::DOUBLE AS level FROM o),
        c AS (SELECT level FROM v WHERE weight * level <= 3 * n ORDER BY before LIMIT 1),
        t AS (SELECT source, n, coalesce(least((3 * n)::DOUBLE, weight * (SELECT level FROM c)), 0) AS target FROM v),
        r AS (SELECT doc_id, s.source, size, n, target, floor(target + 0.5)::BIGINT AS budget,
                     coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
              FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, n::BIGINT AS source_size, target,
               (CASE WHEN n > 0 THEN budget // n ELSE 0 END * size + greatest(0, least(budget - CASE WHEN n > 0 THEN budget // n ELSE 0 END * n - start, size)))::BIGINT AS taken FROM r
    """,
    "op6_near_duplicates": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) > 1 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS g FROM w),
        u AS MATERIALIZED (SELECT min(doc_id) AS id, list_sort(g) AS g FROM s WHERE len(g) > 0 GROUP BY list_sort(g)),
        e AS MATERIALIZED (SELECT id, len(g) AS n, unnest(g) AS x FROM u),
        p AS (SELECT a.id AS a, b.id AS b, a.n, b.n AS m, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4),
        k AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * shared >= 80 * (n + m - shared)),
        l AS MATERIALIZED (SELECT a, b FROM k UNION SELECT b, a FROM k),
        r AS (SELECT id, id AS other FROM u UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
        c AS (SELECT id, min(other) AS root FROM r GROUP BY id),
        m AS (SELECT s.doc_id, len(s.g) AS n, c.root FROM s LEFT JOIN u ON list_sort(s.g) = u.g LEFT JOIN c ON c.id = u.id)
        SELECT doc_id, n AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM m
    """,
    "op9_warc_revisits": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s FROM p),
        o AS (SELECT s, max(page_id) AS o FROM d WHERE n >= 1000 GROUP BY s)
        SELECT d.page_id, d.n AS payload_bytes, d.s AS payload_digest,
               CASE WHEN o.o IS NOT NULL AND o.o <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN o.o IS NOT NULL AND o.o <> d.page_id THEN o.o END AS refers_to
        FROM d LEFT JOIN o ON d.s = o.s
    """,
    "op11_vector_codes": oracles.vector_codes(),
    "op12_periodic_runs": oracles.periodic_runs(),
    "op13_exact_top_k": oracles.exact_top_k(),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
