"""Mixing sources to target weights.

Every document gets a hash-random key, from its id and its text. Within its source documents are ranged by that key into
``16**RANGE_DIGITS`` key ranges (equal shares, as the key is uniform, so a hot source is spread as well as any), and these
into groups by the first half of their digits; prefix sums over groups, over the ranges of a group and inside ranges give
each document the words before it, and the source's budget is cut exactly there.
Texts are read once, for sizes and keys, which are written; only these are shuffled. The mix itself needs one row a source
(whole epochs, and the key at which the budget ends), so texts stay where they are as long as that table is broadcast,
which the session's threshold decides.

Defined cases: a null text has size 0; null is a source of its own, last in order; sources without words get target 0;
repeated rows count as often as they occur, and come down to one row with a count before their shuffle; rows of one id, or
of none, have different keys if their texts differ; ties of keys go to the smaller doc_id, then text hash; a very long
text is one document and may be cut within; an empty table gives no rows; other columns are ignored by ``plan`` and kept
by ``mixed``, whatever they're called. The sources themselves (not documents) are ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, keyed, stored, unkeyed

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the key that name a key range.
RANGE_DIGITS = 4
#: Repeated rows that come out of one row at once.
COPIES = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target from source and size.

    The level L with sum(min(most * size, weight * L)) = sum(size): sources in order of most * size / weight reach their
    limit first, so L follows from running sums over one row a source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")).cast("long")
    rows = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumns(
        {
            "_cap": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "_weight": F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "_total": F.sum("source_size").over(every),
            "_weights": F.sum("weight").over(every),
        }
    )
    level = (F.col("_total") - F.col("_cap")).cast("double") / (F.col("_weights") - F.col("_weight")).cast("double")
    # the first source in that order which its share leaves under its limit sets the level
    fits = F.col("weight") * level <= F.col("cap")
    rows = rows.withColumn("_level", F.min(F.when(fits, F.struct(F.col("_weight"), level.alias("level")))).over(every))
    share = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("_level.level"))
    return rows.select("source", "source_size", F.coalesce(share, F.lit(0.0)).alias("target"))


def _key(seed: str) -> Column:
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.md5(F.concat_ws("|", F.coalesce(unkeyed().cast("string"), F.lit("")), text, F.lit(seed)).cast("binary"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _placed(docs: DataFrame, weights: tuple[int, ...], most: int, seed: str) -> DataFrame:
    """_d, _k, source, _key, size, m (so many equal rows), source_size, target, epochs (whole ones), and left: what the
    source's last epoch takes from the first of these rows on (more than they hold, or none of them)."""
    rows = stored(keyed(docs, "source").select("_d", "_k", "source", _key(seed).alias("_key"), _size().alias("size")), "sizes")
    rows = rows.groupBy("source", "_key", "_d", "_k", "size").agg(F.count("*").alias("m"))
    rows = rows.withColumns({"_range": F.substring("_key", 1, RANGE_DIGITS), "_words": F.col("m") * F.col("size")})
    ranges = stored(rows.groupBy("source", "_range").agg(F.sum("_words").alias("_words")), "ranges")
    # words before a range: those of earlier groups of ranges, and of earlier ranges in its group
    group = F.substring("_range", 1, RANGE_DIGITS // 2)
    groups = ranges.groupBy("source", group.alias("_group")).agg(F.sum("_words").alias("_words"))
    sources = targets(groups.withColumnRenamed("_words", "size"), weights, most)
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    earlier = lambda *by: Window.partitionBy("source", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_before", F.coalesce(F.sum("_words").over(earlier("_group")), F.lit(0)))
    groups = groups.alias("r").join(sources.alias("s"), F.expr("r.source <=> s.source")).select(
        F.col("r.source").alias("_source"), F.col("_group").alias("_group2"), "_before", "source_size", "target", budget.alias("_budget")
    )
    ranges = ranges.withColumn("_group", group).withColumn("_start", F.coalesce(F.sum("_words").over(earlier("_group", "_range")), F.lit(0)))
    ranges = ranges.join(groups, F.expr("source <=> _source and _group = _group2")).select(
        "_source", F.col("_range").alias("_range2"), (F.col("_start") + F.col("_before")).alias("_start"), "source_size", "target", "_budget"
    )
    inside = Window.partitionBy("source", "_range").orderBy("_key", "_d", "_k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_words").over(inside), F.lit(0)))
    rows = rows.join(ranges, F.expr("source <=> _source and _range = _range2"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.col("_budget") - epochs * F.col("source_size") - F.col("_start") - F.col("_inside")
    return rows.select("_d", "_k", "source", "_key", "size", "m", "source_size", "target", epochs.alias("epochs"), left.alias("left"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """_d, _k, source, size, source_size, target, taken: the words that the mix takes of each row, repeats counted."""
    rows = _placed(docs, weights, most, seed)
    last = F.col("m") - 1
    rows = rows.withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPIES).cast("long"))))
    rows = rows.withColumn("_i", F.explode(F.sequence("_a", F.least(F.col("_a") + COPIES - 1, last))))
    left = F.col("left") - F.col("_i") * F.col("size")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size")))
    return rows.select("_d", "_k", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: every row as often as it is taken, the last of a source cut after the word that meets its budget.

    Columns are those of ``docs``; n_chars, where present, follows the text. Documents without words aren't taken.
    """
    placed = _placed(docs, weights, most, seed).filter("size > 0")
    ends = F.min(F.when(F.col("left") < F.col("m") * F.col("size"), F.struct("_key", "_d", "_k", "m", "size", "left")))
    cuts = placed.groupBy("source").agg(F.first("epochs").alias("epochs"), ends.alias("end"))
    cuts = stored(cuts.select(F.col("source").alias("_source"), F.col("epochs"), "end"), "cuts")
    rows = keyed(docs, "source", F.struct("*").alias("_row"))
    rows = rows.select("_row", "source", F.struct(_key(seed).alias("_key"), "_d", "_k").alias("_place"), (_size() > 0).alias("_any")).filter("_any")
    rows = rows.join(cuts, F.expr("source <=> _source"))
    place, end = F.col("_place"), F.struct("end._key", "end._d", "end._k")
    before = F.col("end").isNull() | (place < end)
    # the one row in which the budget ends is cut; of equal rows some are taken whole, from one of them, below
    alone = (place == end) & (F.col("end.m") == 1) & (F.col("end.left") > 0)
    copies = F.array_repeat(F.lit(0).cast("long"), (F.col("epochs") + before.cast("long")).cast("int"))
    copies = F.when(alone, F.concat(copies, F.array("end.left"))).otherwise(copies)
    out = rows.select("_row", F.explode(copies).alias("_cut"))
    if not cuts.filter("end.m > 1 and end.left > 0").isEmpty():
        several = rows.filter(place == end).filter("end.m > 1 and end.left > 0").groupBy("_place", "_source").agg(F.first("_row").alias("_row"), F.first("end").alias("end"))
        whole, rest = F.floor(F.col("end.left") / F.col("end.size")).cast("int"), F.col("end.left") % F.col("end.size")
        copies = F.array_repeat(F.lit(0).cast("long"), whole)
        copies = F.when(rest > 0, F.concat(copies, F.array(rest))).otherwise(copies)
        out = out.union(several.select("_row", F.explode(copies).alias("_cut")))
    words = F.split("_row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.col("_cut") > 0
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("_cut").cast("int")), "")).otherwise(F.col("_row.text"))
    out = out.withColumn("_left", text)
    own = {x: F.col(f"_row.`{x}`") for x in docs.columns} | {"text": F.col("_left")}
    if "n_chars" in own:
        own["n_chars"] = F.when(cut, F.length("_left")).otherwise(own["n_chars"]).cast("long")
    return out.select(*(y.alias(x) for x, y in own.items()))
