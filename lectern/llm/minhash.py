"""MinHash near-dedup from bottom-k sketches of one hash function.

1. Each text's set of two-word shingles becomes its size, a 128-bit fingerprint, its ``k`` least hashes (the sketch) and
   PARITY bits: of the hashes that fall on a bit, whether their number is odd. Rows with equal sets form a class; only
   classes are compared.
2. Inverted lists: three consecutive retained values of a sketch name a list (two for sets of SMALL shingles or fewer).
   Two sets of similarity 0.8 share no list only if the union's sketch has no three neighbours that lie in both: with
   k = 40 a chance of 8e-7, less above 0.8, and none for sets whose union is within the sketch.
3. A list isn't expanded into pairs. Every member is first compared with the list's head, the member whose lists are the
   longest and which therefore is likely the others' origin; then components are formed. The members of lists that still
   hold different components go through prefix filtering, whatever the lists' lengths: with shingles in one order for all
   sets, frequent ones last, sets that are similar enough share one among their first, in number what the threshold
   allows a set to miss.
4. A pair goes on if sizes and parities allow the similarity (sets that differ in at most x shingles differ in at most x
   parity bits: exact), and if its union sketch shows enough common values (for s = 0.8 fewer come with probability below
   1e-9). Full sets of shingle hashes then decide: first each member's NEAREST pairs by parities, then those of the other
   pairs whose ends are in different components yet. So a member of a large group is verified against a few others, and
   no link between components is lost.

Full sets are made once, for members of lists; texts move once at most.

Defined cases: null texts and texts without words have no shingles and are linked with nothing; a text of one word has
that word as its only shingle; repeated rows are in one class; ties of size or rank go to the greater fingerprint; very
long texts are hashed in pieces, and their sets are as whole as any; a null doc_id counts as the smallest; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import chosen, discard, keyed, once, stored
from .words import ROWS, mix, texts, windows, word_hashes

SHINGLE = 2
PERCENT = 80
SKETCH = 40
#: Sets of so many shingles at most are also found by two consecutive values.
SMALL = 5
#: Common values of a union sketch of SKETCH values that a pair needs to be verified.
LEAST_COMMON = 15
#: Words of 64 parity bits.
PARITY = 4
_BITS = [f"b{i}" for i in range(PARITY)]
#: Pairs of a member that are verified before the others.
NEAREST = 4
#: How many of the most frequent shingles are known as such and come last, and in how many sets they are counted. The
#: order is the same for all sets, whatever it is; it matters to speed alone.
FREQUENT, COUNTED = 200_000, 20_000
_BASE = 0xD6E8FEB86659FD93
#: Sets of fewer shingles are similar to equal sets alone.
LEAST_SET = 4


def shingle_set(data: bytes, length: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    w = word_hashes(data.lower())
    if not len(w):
        return w
    return np.unique(windows(w, min(length, len(w)), _BASE))


def parities(s: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY bits whether an odd number of the hashes falls on it, as PARITY signed words."""
    odd = np.bincount((s & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))


def _sketches(docs: DataFrame, length: int, k: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, d, key in texts(batches, "_d", "_k"):
            sizes, prints, least, bits = [], [], [], []
            for x in text:
                s = shingle_set(x, length)
                sizes.append(len(s))
                both = (int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                prints.append(both[0].to_bytes(8) + both[1].to_bytes(8))
                least.append(s[:k])
                bits.append(parities(s))
            columns = [pa.array(d, pa.int64()), pa.array(key, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), _lists(least)]
            columns += [pa.array(np.ascontiguousarray(x), pa.int64()) for x in np.stack(bits).T]
            yield pa.RecordBatch.from_arrays(columns, ["_d", "_k", "n", "c", "sketch", *_BITS])

    kinds = "".join(f", {x} long" for x in _BITS)
    return keyed(docs).mapInArrow(sketch, f"_d long, _k long, n long, c binary, sketch array<long>{kinds}")


def _sets(docs: DataFrame, length: int) -> DataFrame:
    """c, n, parities and members, the whole set, of each row of ``docs`` (c, text)."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, c in texts(batches, "c"):
            found = [shingle_set(x, length) for x in text]
            bits = [pa.array(np.ascontiguousarray(x), pa.int64()) for x in np.stack([parities(x) for x in found]).T]
            columns = [pa.array(c, pa.binary()), pa.array([len(x) for x in found], pa.int64()), *bits, _lists(found)]
            yield pa.RecordBatch.from_arrays(columns, ["c", "n", *_BITS, "members"])

    kinds = "".join(f", {x} long" for x in _BITS)
    return docs.mapInArrow(full, f"c binary, n long{kinds}, members array<long>")


def common_in_union(a: Column, b: Column, k: int) -> Column:
    """Of the k least values of both sketches together, how many both hold."""
    union = F.slice(F.sort_array(F.array_union(_unsigned(a), _unsigned(b))), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(_unsigned(a), _unsigned(b))))


def _unsigned(a: Column) -> Column:
    """Values in an order that sorts as the unsigned hashes do."""
    return F.transform(a, lambda x: x.bitwiseXOR(F.lit(-(2**63))))


def _differ(a: str, b: str) -> str:
    """SQL: the parity bits in which two sets (prefixes of column names) differ; they differ in as many shingles at least."""
    return "(" + " + ".join(f"bit_count({a}{x} ^ {b}{x})" for x in _BITS) + ")"


def _may_link(a: str, b: str, percent: int) -> str:
    """SQL: sizes and parities of two sets (prefixes of column names) allow the similarity."""
    least = f"ceil({percent} * ({a}n + {b}n) / {100 + percent}.0)"
    fits = f"100 * least({a}n, {b}n) >= {percent} * greatest({a}n, {b}n)"
    return f"{fits} and {_differ(a, b)} <= {a}n + {b}n - 2 * {least}"


def _linked(pairs: DataFrame, members: DataFrame, sets: DataFrame, k: int, percent: int, least: int) -> DataFrame:
    """u, v of the pairs (u, v) whose full sets are similar enough; written."""

    def side(name: str) -> DataFrame:
        return members.select(F.col("c").alias(name), F.struct("n", "sketch", *_BITS).alias(f"{name}x"))

    near = pairs.join(side("u"), "u").join(side("v"), "v").filter(F.expr(_may_link("ux.", "vx.", percent)))
    enough = F.least(F.lit(least), F.floor(F.greatest("ux.n", "vx.n") * least / k))
    near = near.filter(common_in_union(F.col("ux.sketch"), F.col("vx.sketch"), k) >= enough)
    near = stored(near.select("u", "v", F.col("ux.n").alias("un"), F.col("vx.n").alias("vn")), "near")
    ends = stored(near.select(F.explode(F.array("u", "v")).alias("c")).distinct(), "ends")
    sets = chosen(sets, ends, ("c",), "left_semi")
    both = F.size(F.array_intersect("um", "vm"))
    found = (
        near.join(sets.select(F.col("c").alias("u"), F.col("members").alias("um")), "u")
        .join(sets.select(F.col("c").alias("v"), F.col("members").alias("vm")), "v")
        .filter(100 * both >= percent * (F.col("un") + F.col("vn") - both))
        .select("u", "v")
    )
    found = stored(found, "links")
    discard(near, ends)
    return found


def _prefix_pairs(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v, differ: of the classes in ``apart`` (c, root), a stored table, those in different components that share a
    shingle of their prefixes and may be linked.

    Two sets of a and b shingles with similarity percent / 100 share at least o = percent * (a + b) / (100 + percent), so
    that one of the first a - o + 1 of the one is among the first b - o + 1 of the other.
    """
    some = sets.join(F.broadcast(apart.orderBy(F.xxhash64("c"), "c").limit(COUNTED).select("c")), "c", "left_semi")
    counts = some.select(F.explode("members").alias("x")).groupBy("x").agg(F.count("*").alias("m"))
    frequent = counts.filter("m > 2").orderBy(F.desc("m"), "x").limit(FREQUENT).toPandas().sort_values("x")
    known, often = frequent["x"].to_numpy(np.int64), frequent["m"].to_numpy(np.int64)
    kept = ["c", "n", "r", *_BITS]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                owner, place, value = [], [], []
                for i, x in enumerate(part.column("members")):
                    x = x.values.to_numpy(zero_copy_only=False)
                    at = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
                    weight = np.where(known[at] == x, often[at], 0) if len(known) else np.zeros(len(x), np.int64)
                    x = x[np.lexsort((x, weight))][: len(x) - -(-percent * len(x) // 100) + 1]
                    owner.append(np.full(len(x), i))
                    place.append(np.arange(len(x)))
                    value.append(x)
                rows = part.select(kept).take(pa.array(np.concatenate(owner)))
                columns = [*rows.columns, pa.array(np.concatenate(place), pa.int32()), pa.array(np.concatenate(value), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "place", "x"])

    kinds = "".join(f", {x} long" for x in _BITS)
    rows = chosen(sets, apart, ("c",)).select("c", "n", F.xxhash64("root").alias("r"), *_BITS, "members")
    entries = stored(rows.mapInArrow(first, f"c binary, n long, r long{kinds}, place int, x long"), "prefixes")
    least = f"ceil({percent} * (a.n + b.n) / {100 + percent}.0)"
    shorter = entries.filter(F.expr(f"place <= n - ceil(2 * {percent} * n / {100 + percent}.0)")).alias("b")
    size = f"(a.n > b.n or (a.n = b.n and a.c > b.c)) and {_may_link('a.', 'b.', percent)}"
    found = entries.alias("a").join(shorter, F.expr(f"a.x = b.x and a.r <> b.r and a.place <= a.n - {least} and b.place <= b.n - {least} and {size}"))
    found = found.select(F.least("a.c", "b.c").alias("u"), F.greatest("a.c", "b.c").alias("v"), F.expr(_differ("a.", "b.")).alias("differ"))
    found = stored(found.distinct(), "rest")
    discard(entries)
    return found


def _nearest(pairs: DataFrame, most: int) -> DataFrame:
    """u, v: the ``most`` pairs (u, v, differ) of each end that differ least."""
    ends = pairs.withColumn("e", F.explode(F.array("u", "v")))
    place = F.row_number().over(Window.partitionBy("e").orderBy("differ", "u", "v"))
    return ends.withColumn("place", place).filter(F.col("place") <= most).select("u", "v").distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for end in ("u", "v"):
        pairs = pairs.join(roots.select(F.col("u").alias(end), F.col("root").alias(f"{end}r")), end, "left")
    return pairs.filter(F.coalesce("ur", "u") != F.coalesce("vr", "v")).drop("ur", "vr")


def near_duplicates(docs: DataFrame, length: int = SHINGLE, percent: int = PERCENT, k: int = SKETCH, least: int = LEAST_COMMON) -> DataFrame:
    """_d, _k, n, component (a ``_d``) and root (a class, as two components can have one ``_d``; null without words): one row for each row of ``docs``."""
    if percent < PERCENT:
        raise ValueError(f"the lists find pairs of a similarity of {PERCENT} percent or more")
    rows = stored(_sketches(docs, length, k), "sketches")
    columns = ["n", "sketch", *_BITS]
    classes = rows.filter("n > 0").groupBy("c").agg(F.min(F.struct("_d", "_k")).alias("_row"), F.first(F.struct(*columns)).alias("_set"))
    classes = stored(classes.select("c", "_row._d", "_row._k", "_set.*"), "classes")

    def runs_of(many: int) -> Column:
        last = F.size("sketch") - (many - 1)
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.lit(many), *(F.element_at("sketch", i + j) for j in range(many))))

    n = F.col("n")
    keys = F.when(n < SMALL, runs_of(2)).when(n == SMALL, F.concat(runs_of(2), runs_of(3))).otherwise(runs_of(3))
    lists = classes.filter(n >= LEAST_SET).select(F.explode(keys).alias("key"), "c", "n")
    sizes = stored(lists.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "sizes")
    every = stored(lists.join(sizes, "key"), "lists")
    ranks = every.groupBy("c").agg(F.sum(F.log2("m")).alias("rank"))
    members = stored(ranks.join(classes, "c"), "members")
    again = stored(rows.groupBy("_d", "_k").agg(F.count("*").alias("m")).filter("m > 1").select("_d", "_k"), "repeated")
    sets = stored(_sets(once(keyed(docs), members.select("c", "_d", "_k"), again), length), "sets")
    heads = every.join(members.select("c", "rank"), "c").groupBy("key").agg(F.max(F.struct("rank", "c", "n")).alias("head"))
    shared = every.join(heads, "key").select("key", "c", "n", F.col("head.c").alias("head"), F.col("head.n").alias("hn"))
    ordered = [F.least("c", "head").alias("u"), F.greatest("c", "head").alias("v")]
    pairs = shared.filter((F.col("c") != F.col("head")) & _sizes_fit("n", "hn", percent)).select(*ordered).distinct()
    pairs = stored(pairs, "pairs")
    links = _linked(pairs, members, sets, k, percent, least)
    roots = components(links)
    # the rest: members of one list that are in different components yet
    placed = every.join(roots.withColumnRenamed("u", "c"), "c", "left").select("key", "c", F.coalesce("root", "c").alias("root"))
    placed = stored(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
    apart = stored(placed.join(mixed, "key", "left_semi").select("c", "root").distinct(), "apart")
    discard(every, sizes, placed)
    rest = _prefix_pairs(apart, sets, percent)
    untried = stored(rest.join(pairs, ["u", "v"], "left_anti"), "untried")
    first = stored(_nearest(untried, NEAREST), "nearest")
    more = _linked(first, members, sets, k, percent, least)
    if not more.isEmpty():
        links = stored(links.union(more), "all-links")
        roots = components(links)
    others = stored(_apart(untried.join(first, ["u", "v"], "left_anti").select("u", "v"), roots), "others")
    more = _linked(others, members, sets, k, percent, least)
    if not more.isEmpty():
        roots = components(links.union(more))
    discard(members, again, sets, pairs, apart, rest, untried, first, others)
    named = classes.join(roots.withColumnRenamed("u", "c"), "c", "left").select("c", F.coalesce("root", "c").alias("root"), "_d")
    named = stored(named, "named")
    smallest = named.groupBy("root").agg(F.min("_d").alias("component"))
    named = named.join(smallest, "root").select("c", "component", "root")
    out = rows.filter("n > 0").join(named, "c").select("_d", "_k", "n", "component", "root")
    return out.unionByName(rows.filter("n = 0").select("_d", "_k", "n", F.col("_d").alias("component"), F.lit(None).cast("binary").alias("root")))


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)
