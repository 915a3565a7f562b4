"""The reference corpus's dedup in stages: reject, equal files, equal DOIs, like titles and texts; who survives, and the account.

A record: id, source_group, doc_type, open_error, sha256, images_only, doi, title, text, has_references, file_name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.inventory import REJECTED_TYPES
from lectern.functions.text import sanitized, text_norm, titles_match
from lectern.operators.corpus import FINGERPRINT, NEAR, body_grams, components, gram_pairs
from lectern.sources.places import fresh_place

#: The group of files that were rejected before, and the least text of a paper.
PRIOR, LEAST_TEXT = "papers_rejected_prior", 200


def is_rejected(length: Column) -> Column:
    """Whether a record is no usable paper, over source_group, doc_type, open_error, sha256 and images_only."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        (F.col("source_group") == PRIOR) | F.col("doc_type").isin(*REJECTED_TYPES) | ~blank("open_error") | blank("sha256")
        | F.coalesce(F.col("images_only"), F.lit(False)) | (length < LEAST_TEXT)
    )


def quality(length: Column) -> Column:
    """What makes the better of two copies: a DOI, references, more text, then the later file name."""
    return F.struct((F.col("doi") != "").alias("a"), F.col("has_references").alias("b"), length.alias("c"), F.lower("file_name").alias("d"), (-F.col("id")).alias("e"))


def survivors(rows: DataFrame, key: str) -> DataFrame:
    """id, survivor: of the rows of one key that of the best ``q``; a key's rows are combined before their shuffle."""
    best = rows.groupBy(key).agg(F.max_by("id", "q").alias("survivor"))
    return rows.join(best, key).select("id", "survivor")


def like_pairs(rows: DataFrame, least: float = NEAR) -> DataFrame:
    """a, b: records (id, doi, t, x, grams) whose titles match and whose texts are equal or share enough grams.

    Texts give the pairs: equal fingerprints go to the first of them, near ones come from prefix filtering over grams.
    Two records with a DOI each aren't compared.
    """
    same = rows.filter("x <> ''").groupBy("x").agg(F.min("id").alias("a"))
    by_print = rows.filter("x <> ''").join(same, "x").filter("a <> id").select("a", F.col("id").alias("b"))
    near = gram_pairs(rows.filter("grams is not null").select("id", "grams"), least).select("a", "b")
    pairs = by_print.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda n: rows.select(F.col("id").alias(n), F.struct("doi", "title").alias(f"{n}r"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    both = (F.col("ar.doi") != "") & (F.col("br.doi") != "")
    return met.filter(~both & titles_match(F.col("ar.title"), F.col("br.title"))).select("a", "b")


def staged(records: DataFrame) -> DataFrame:
    """id, disposition, survivor, resolution of every record.

    disposition: rejected, sha256, doi, title_text (a duplicate by that), or kept; survivor: the record that stands for a
    duplicate; resolution of kept ones: unique_doi, unique_title_text, or unresolved (nothing but itself tells it apart).
    """
    spark = records.sparkSession
    length = F.length(F.coalesce("text", F.lit("")))
    grams = body_grams(F.col("t"))
    rows = records.withColumns({"t": text_norm(F.col("text")), "bad": F.coalesce(is_rejected(length), F.lit(False)), "q": quality(length)})
    rows = rows.withColumns({"x": F.when(F.col("t") != "", F.sha2(F.substring("t", 1, FINGERPRINT).cast("binary"), 256)).otherwise(""), "grams": grams})
    place = fresh_place(spark, "records")
    rows.select("id", "bad", "sha256", "doi", "title", "q", "x", "grams").write.parquet(place)
    rows = spark.read.parquet(place)
    pool = rows.filter("not bad")
    by_sha = survivors(pool, "sha256")
    left = pool.join(by_sha.filter("id = survivor").select("id"), "id")
    by_doi = survivors(left.filter("doi <> ''"), "doi")
    nodes = left.filter("doi = ''").unionByName(left.join(by_doi.filter("id = survivor").select("id"), "id"))
    roots = components(like_pairs(nodes))
    grouped = nodes.join(roots, "id").select("id", "root", "q")
    by_text = survivors(grouped, "root")
    kinds = (("sha256", by_sha), ("doi", by_doi), ("title_text", by_text))
    out = rows.select("id", "bad", F.col("doi").alias("_doi"))
    for kind, found in kinds:
        out = out.join(found.select("id", F.col("survivor").alias(f"by_{kind}")), "id", "left")
    best = lambda kind: F.col(f"by_{kind}")
    lost = lambda kind: best(kind).isNotNull() & (best(kind) != F.col("id"))
    disposition = F.when(F.col("bad"), "rejected")
    for kind, _ in kinds:
        disposition = disposition.when(lost(kind), kind)
    disposition = disposition.otherwise("kept")
    survivor = F.coalesce(*(F.when(lost(kind), best(kind)) for kind, _ in kinds))
    resolution = F.when(F.col("_doi") != "", "unique_doi").when(best("title_text").isNotNull(), "unique_title_text").otherwise("unresolved")
    return out.select("id", disposition.alias("disposition"), survivor.alias("survivor"), F.when(disposition == "kept", resolution).otherwise("").alias("resolution"))


def accounting(dispositions: DataFrame) -> DataFrame:
    """One row: how many records there are, and where they went; total is the sum of the parts."""
    n = lambda kind: F.count_if(F.col("disposition") == kind)
    return dispositions.agg(
        F.count("*").alias("total"), n("rejected").alias("rejected"), (F.count("*") - n("rejected")).alias("pool"), n("sha256").alias("sha_dup"), n("doi").alias("doi_dup"),
        n("title_text").alias("titletext_dup"), F.count_if(F.col("resolution") == "unresolved").alias("unresolved"), n("kept").alias("final"),
    )


def unique_names(rows: DataFrame, folder: str = "folder", name: str = "file_name") -> DataFrame:
    """id, folder, file: safe names, unique in their folder whatever their case; later ones (by id) get _2, _3 and so on.

    A name that already looks like a numbered one can meet a numbered one; the file's id then tells them apart.
    """
    safe = sanitized(F.col(name))
    ext = F.regexp_extract(safe, r"(\.[^.]+)$", 1)
    stem = F.when(ext != "", F.substring(safe, F.lit(1), F.length(safe) - F.length(ext))).otherwise(safe)
    kind = F.when(ext != "", ext).otherwise(".pdf")
    rows = rows.select("id", F.col(folder).alias("folder"), stem.alias("_stem"), kind.alias("_ext"))
    n = F.row_number().over(Window.partitionBy("folder", F.lower(F.concat("_stem", "_ext"))).orderBy("id"))
    rows = rows.withColumn("file", F.concat("_stem", F.when(n > 1, F.concat(F.lit("_"), n)).otherwise(""), "_ext"))
    again = F.row_number().over(Window.partitionBy("folder", F.lower("file")).orderBy("id"))
    return rows.withColumn("file", F.when(again > 1, F.concat(F.regexp_replace("file", r"(\.[^.]+)$", ""), F.lit("_id"), F.col("id"), F.col("_ext"))).otherwise(F.col("file"))).select("id", "folder", "file")

