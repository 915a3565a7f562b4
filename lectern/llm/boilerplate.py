"""Line dedup across sites, in DataFrame operations only.

A line (trimmed of blanks) is boilerplate if it stands on ``least`` or more different sources. Texts are split once, into
a written table of 128-bit line hashes; all that follows works on it. Occurrences come down to one row for each line and
site before their shuffle, so that the most common line is as many rows as it has sites. The spread is estimated with one
HyperLogLog sketch for each line hash, merged by aggregation, partly before the shuffle. Estimates far from the threshold
decide at once; lines near it (half to twice) get exact distinct counts. Boilerplate is removed everywhere but at its
first occurrence in the corpus (smallest doc_id, then line number), so that no text disappears altogether. Occurrences of
boilerplate are found by a plain join, which adaptive execution splits where a line is hot. Texts move at most once, to
meet the numbers of the lines they lose.

Defined cases: lines of blanks alone are never boilerplate and stay; a null source is no site; null texts have no lines
and stay null; repeated rows lose the same lines, as each other's copies; ties of doc_id go to the smaller text hash; a
very long text is one row, whose lines are looked up in linear time; an empty table gives no rows; other columns are kept
as they are, whatever they're called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keyed, matched, stored, with_keys

LEAST_SITES = 10
#: 2**LG_K registers: a relative standard error of about 3 % far above, and nearly exact counts below about a hundred.
LG_K = 10
#: Estimates between these multiples of the threshold are counted exactly.
NEAR = (0.5, 2.0)


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _lines(docs: DataFrame) -> DataFrame:
    rows = keyed(docs, "source").select("_d", "_k", F.xxhash64("source").alias("site"), "source", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    bare = rows.withColumn("line", _bare(F.col("line"))).filter("line <> ''")
    site = F.when(F.col("source").isNotNull(), F.col("site")).alias("site")
    return bare.select("_d", "_k", site, "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def boilerplate(lines: DataFrame, least: int = LEAST_SITES) -> DataFrame:
    """h1, h2, sites and the first occurrence (d, k, at) of each line that is on ``least`` sites or more."""
    sites = stored(lines.groupBy("h1", "h2", "site").agg(F.min(F.struct("_d", "_k", "at")).alias("first")), "sites")
    # lines of one site can't be boilerplate; this leaves them out before sketches are made
    spread = sites.groupBy("h1", "h2").agg(F.min("site").alias("low"), F.max("site").alias("high"))
    spread = stored(spread.filter("low <> high").select("h1", "h2"), "spread")
    sketches = sites.join(spread, ["h1", "h2"]).groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("about"), F.min("first").alias("first")
    )
    sketches = stored(sketches.filter(F.col("about") >= NEAR[0] * least), "sketches")
    near = sketches.filter(F.col("about") <= NEAR[1] * least)
    exact = sites.join(near.select("h1", "h2"), ["h1", "h2"]).groupBy("h1", "h2").agg(F.count("site").alias("sites"))
    counted = near.join(exact, ["h1", "h2"]).filter(F.col("sites") >= least)
    far = sketches.filter(F.col("about") > NEAR[1] * least).withColumn("sites", F.col("about"))
    return counted.select("h1", "h2", "sites", "first").unionByName(far.select("h1", "h2", "sites", "first"))


def removed_lines(docs: DataFrame, least: int = LEAST_SITES) -> DataFrame:
    """_d, _k, gone: the numbers (from 0) of the lines that each text loses; texts that lose none are left out."""
    lines = stored(_lines(docs), "lines")
    found = stored(boilerplate(lines, least).select("h1", "h2", "first"), "boilerplate")
    hits = lines.join(found, ["h1", "h2"]).filter(F.struct("_d", "_k", "at") != F.col("first"))
    return hits.groupBy("_d", "_k").agg(F.collect_set("at").alias("gone"))


def deduplicated(docs: DataFrame, least: int = LEAST_SITES) -> DataFrame:
    """The rows of ``docs`` with their texts as left; added: _n_lines, _n_removed. n_chars, where present, follows."""
    gone = stored(removed_lines(docs, least), "removed")
    rows = matched(with_keys(docs), gone, "left").withColumn("_lines", F.split("_row.text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("gone"))
    text = F.array_join(F.transform(left, lambda i: F.col("_lines")[i]), "\n")
    counts = {"_n_lines": F.coalesce(F.size("_lines"), F.lit(0)), "_n_removed": F.coalesce(F.size("gone"), F.lit(0))}
    rows = rows.withColumns({x: y.cast("long") for x, y in counts.items()})
    rows = rows.withColumn("_left", F.when(F.col("gone").isNull(), F.col("_row.text")).otherwise(text))
    own = {x: F.col(f"_row.`{x}`") for x in docs.columns} | {"text": F.col("_left")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("_n_removed") > 0, F.length("_left").cast("long")).otherwise(own["n_chars"])
    return rows.select(*(y.alias(x) for x, y in own.items()), "_n_lines", "_n_removed")
