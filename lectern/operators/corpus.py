"""Corpus maintenance: exact and near duplicates, components, scores, quota selection, triage, integrity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import content_tokens, let, text_norm
from lectern.sources.places import fresh_place, shared_place, written

NEAR = 0.85
GRAM, LEAST_STRIDE, MOST_GRAMS = 48, 24, 900
#: Normal characters of a body that its fingerprint covers; title similarities from which a candidate is a suspect and a duplicate.
FINGERPRINT = 4000
FLAGGED, CONFIRMED = 0.8, 0.9
#: Rules of selection.
MIN_YEAR, RECENT_YEAR, TRIM_RECENT_YEAR = 1990, 2023, 2020
PER_AUTHOR, PER_JOURNAL, REVIEW_SHARE, RECENT_SHARE, A_SHARE = 3, 10, 0.25, 0.3, 0.7
RESERVE, RESERVE_PER_TOPIC = 40, 6
REVIEW_TITLE = r"(?i)\b(review|critical review|systematic review|meta[- ]analysis|perspective|minireview|tutorial|roadmap|state[- ]of[- ]the[- ]art)\b"
HN_OFF_TOPIC = r"(?i)\b(soil|terrestrial|epidemiolog|clinical|patients?|food chain|crops?|agricultur|air pollut|atmosphere|indoor dust)\b"
HN_WATER = r"(?i)\b(wastewater|water|aquatic|freshwater|marine|rivers?|lakes?|drinking|effluent|sewage|treatment plant|groundwater|surface water|sediments?)\b"
HN_KEEP = (
    r"(?i)\b(occurrence|distribution|fate|burden|surveillance|detection|monitoring|abundance|exposure|ecotoxicity|toxicity|presence|levels?|prevalence|"
    r"assessment|accumulation|transport|behavio[u]?r|sources?|tracing)\b"
)
HN_TREATMENT = (
    r"(?i)\b(removal|degradation|decomposition|elimination|treatment of|for water treatment|adsorption of .+ from (aqueous|water)|photocatalytic degradation|"
    r"advanced oxidation of)\b"
)


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def exact_groups(docs: DataFrame) -> DataFrame:
    """sha256, n, survivor: equal texts, which differ in nothing but their ids, and the smallest of these."""
    return docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("survivor"))


def body_grams(text: Column) -> Column:
    """Distinct grams of a normal text (a column, as it's read once a gram) at a stride that leaves at most about MOST_GRAMS; short texts have none."""
    t = text
    stride = F.greatest(F.lit(LEAST_STRIDE), F.floor((F.length(t) - GRAM) / MOST_GRAMS).cast("int") + 1)
    starts = F.sequence(F.lit(1), F.length(t) - GRAM + 1, stride)
    return F.when(F.length(t) >= GRAM, F.array_distinct(F.transform(starts, lambda i: F.substring(t, i, F.lit(GRAM)))))


def near_pairs(docs: DataFrame, least: float = NEAR) -> DataFrame:
    """a, b, similarity of representatives (the smallest doc_id) of texts with equal grams, over shared grams.

    Copies are collapsed first, so a gram's list holds different texts only.
    """
    rows = docs.select("doc_id", let(text_norm(F.col("text")), body_grams).alias("grams")).filter("grams is not null")
    return gram_pairs(rows.groupBy(_gram_hash(F.col("grams")).alias("h")).agg(F.min("doc_id").alias("id"), F.first("grams").alias("grams")), least)


def _gram_hash(grams: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(grams), "|"), 256)


def gram_pairs(sets: DataFrame, least: float = NEAR) -> DataFrame:
    """a, b, similarity of gram sets (id, grams) of a Jaccard of ``least`` or more, exactly.

    Prefix filtering: with the rarest grams first, two sets that are similar enough share one among the first
    n - ceil(least * n) + 1 of each. Sizes and places in the prefix leave out most other pairs; whole sets then decide.
    The sets are written first, as they're read three times and come from texts.
    """
    sets = written(sets.select("id", "grams"), "sets")
    each = sets.select("id", F.size("grams").alias("n"), F.explode(F.transform("grams", lambda x: F.xxhash64(x))).alias("g"))
    counts = each.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("m", F.lit(1)), "g"))
    placed = each.join(counts, "g", "left").withColumn("p", place).filter(F.col("m").isNotNull() & (F.col("p") <= F.col("n") - F.ceil(F.col("n") * least) + 1))
    x, y = placed.alias("x"), placed.alias("y")
    o = f"ceil({least} * (x.n + y.n) / {1 + least} - 1e-9)"
    fits = f"x.g = y.g and x.id < y.id and least(x.n, y.n) >= {least} * greatest(x.n, y.n) - 1e-9 and x.p <= x.n - {o} + 1 and y.p <= y.n - {o} + 1"
    pairs = x.join(y, F.expr(fits)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    s = F.round(both / (F.size("ga") + F.size("gb") - both), 6)
    return met.select("a", "b", s.alias("similarity")).filter(F.col("similarity") >= least)


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """id, root for the ends of the links (a, b): least labels spread along links and are then followed to their own labels."""
    shared_place(links.sparkSession)
    edges = links.select("a", "b").union(links.select("b", "a")).distinct().checkpoint()
    labels = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")).checkpoint()
    before = None
    for _ in range(most):
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("m"))
        labels = labels.join(near, "id").select("id", F.least("root", "m").alias("root"))
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("next"))
        labels = labels.join(up, "root").select("id", "next").withColumnRenamed("next", "root").checkpoint()
        now = labels.agg(F.sum(F.xxhash64("id", "root").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels
        before = now
    raise RuntimeError("components didn't settle")


def duplicate_roots(docs: DataFrame, least: float = NEAR) -> DataFrame:
    """doc_id, root for every row: the smallest doc_id that its text is linked to; its own where there's no link.

    Equal normal texts of any length, compared whole, texts with equal grams and near pairs are linked. Rows find their root
    by their text's class; doc_ids only name roots. Texts without letters and digits are linked with nothing.
    """
    shared_place(docs.sparkSession)
    texts = written(docs.select("doc_id", text_norm(F.col("text")).alias("_t")), "normal")  # each form once: an inlined one is made again for every use
    whole = F.when(F.col("_t") != "", F.sha2(F.col("_t").cast("binary"), 256))
    rows = written(texts.select("doc_id", whole.alias("whole"), body_grams(F.col("_t")).alias("grams")), "grams")
    # equal texts have equal grams; those too short for grams are told apart by the whole text
    node = F.coalesce(F.concat(F.lit("g"), _gram_hash(F.col("grams"))), F.concat(F.lit("f"), F.col("whole")))
    of_rows = rows.select("doc_id", node.alias("node")).checkpoint()
    near = gram_pairs(rows.filter("grams is not null").groupBy(node.alias("id")).agg(F.first("grams").alias("grams")), least).select("a", "b")
    firsts = of_rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = firsts.join(components(near).withColumnRenamed("id", "node"), "node", "left")
    named = named.select("node", F.coalesce("root", "node").alias("class"), "first").checkpoint()
    least_id = named.groupBy("class").agg(F.min("first").alias("root"))
    return of_rows.join(named.join(least_id, "class").select("node", "root"), "node", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))


#: Lists of at most so many sets are looked through; longer ones are split by one more shared token.
EXPANDED = 16


def best_titles(rows: DataFrame) -> DataFrame:
    """id, best_id, similarity, flagged, confirmed: of all other titles the one with the largest Jaccard of tokens, then the smallest id.

    Equal token sets are compared once, and rows that have a twin are done with it.
    """
    titles = rows.select("id", F.array_sort(content_tokens(F.col("title"))).alias("tokens"))
    two = titles.filter(F.size("tokens") > 0)
    two = two.withColumn("_n", F.row_number().over(Window.partitionBy("tokens").orderBy("id"))).filter("_n <= 2")
    sets = two.groupBy("tokens").agg(F.min("id").alias("first"), F.max(F.when(F.col("_n") == 2, F.col("id"))).alias("second"))
    sets = written(sets, "sets")
    best = best_sets(sets.select(F.col("first").alias("id"), "tokens", F.col("second").isNull().alias("asks")))
    found = titles.join(sets.join(best.withColumnRenamed("id", "first"), "first", "left"), "tokens", "left")
    twin = F.when(F.col("second").isNotNull(), F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")))
    similarity = F.when(twin.isNotNull(), 1.0).otherwise(F.coalesce("similarity", F.lit(0.0)))
    return found.select(
        "id",
        F.coalesce(twin, F.col("other")).alias("best_id"),
        F.round(similarity, 6).alias("similarity"),
        (similarity >= FLAGGED).alias("flagged"),
        (similarity >= CONFIRMED).alias("confirmed"),
    )


def best_sets(sets: DataFrame, most: int = EXPANDED, rows_met: list[int] | None = None) -> DataFrame:
    """id, similarity, other: for each of the distinct sets (id, tokens, asks) that ``asks``, the other set with the largest
    Jaccard, then the smallest id; none where no token is shared.

    Tokens are in one order, rarest first. A list holds the sets that have some tokens in common: one token at first. What
    is known of a list is how many sets of each size it has and the two smallest ids of these. Each set that asks keeps the
    best similarity so far, a bound that rises from list to list. From its lists it learns a lower bound: a set of m tokens
    that shares these s has a similarity of s / (n + m - s) at least, and of all that share no more of them the smallest id of
    a size is the best one. What a size can still offer is bounded by the tokens that come after the list's last one, by
    their places in both sets; a size that can't beat the bound, or tie with it by a smaller id, is left. If few sets are
    left in a list, they're compared in full; a longer list is split into lists that share one more of the asking set's
    later tokens. So no list is ever multiplied by itself.

    The first bounds come from suffixes, which hold the most frequent tokens: sets that are alike but for rare tokens meet
    there. ``rows_met``: gets the number of rows that each step's joins made.
    """
    each = sets.select("id", F.explode("tokens").alias("t"))
    counts = each.groupBy("t").agg(F.count("*").alias("m"))
    ordered = each.join(counts, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("m", "t"))).alias("x"))
    ordered = sets.select("id", "asks").join(ordered, "id")
    ordered = written(ordered.select("id", "asks", F.transform("x", lambda x: x["t"]).alias("tokens"), F.size("x").alias("n")), "ordered")
    asking = ordered.filter("asks")
    if asking.isEmpty():
        return asking.select("id", F.lit(0.0).alias("similarity"), F.col("id").alias("other"))

    def better(*found: DataFrame) -> DataFrame:
        """The best of (id, similarity, other)."""
        every = found[0]
        for x in found[1:]:
            every = every.unionByName(x)
        top = every.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("other")).alias("o"))).alias("top"))
        return written(top.select("id", "top.similarity", (-F.col("top.o")).alias("other")), "best")

    def met(x: DataFrame) -> DataFrame:
        if rows_met is not None:
            rows_met.append(x.count())
        return x

    def lists_of(members: DataFrame) -> DataFrame:
        """key, m, c, heads: of the sets (key, other, m) of a list and a size the number and the two smallest ids."""
        heads = members.withColumn("r", F.row_number().over(Window.partitionBy("key", "m").orderBy("other"))).filter("r <= 2")
        heads = heads.groupBy("key", "m").agg(F.min("other").alias("h1"), F.max(F.when(F.col("r") == 2, F.col("other"))).alias("h2"))
        return members.groupBy("key", "m").agg(F.count("*").alias("c")).join(heads, ["key", "m"])

    head = F.when(F.col("h1") != F.col("id"), F.col("h1")).otherwise(F.col("h2"))
    joined = lambda tokens: F.array_join(tokens, "\x00")

    ends = ordered.filter("n > 1").select("id", "n", "asks", F.expr("transform(sequence(2, n), i -> slice(tokens, i, n))").alias("ends"))
    ends = ends.select("id", "n", "asks", F.explode("ends").alias("e")).select("id", "n", "asks", F.size("e").alias("s"), F.md5(joined(F.col("e"))).alias("key"))
    common = lists_of(ends.select("key", F.col("id").alias("other"), F.col("n").alias("m")))
    alike = ends.filter("asks").join(common, "key").withColumn("other", head).filter("other is not null")
    best = better(met(alike.select("id", (F.col("s") / (F.col("n") + F.col("m") - F.col("s"))).alias("similarity"), "other")))

    members = ordered.select(F.posexplode("tokens").alias("q", "key"), F.col("id").alias("other"), F.col("n").alias("m"), F.col("tokens").alias("there"))
    frontier = asking.select("id", "n", "tokens", F.posexplode("tokens").alias("p", "key"))
    s = 1
    while True:
        members = written(members, "members")
        lists = lists_of(members)
        asked = met(written(frontier.join(lists, "key").withColumn("head", head).filter("head is not null"), "asked"))
        least = F.lit(s) / (F.col("n") + F.col("m") - s)
        best = better(best, asked.select("id", least.alias("similarity"), F.col("head").alias("other")))
        # shared at most: these tokens and those after the last of them in the asking set, none beyond the other's size
        o = F.lit(s) + F.least(F.col("n") - F.col("p") - 1, F.col("m") - s)
        bound = o / (F.col("n") + F.col("m") - o)
        open_ = asked.join(best, "id").filter((o > s) & ((bound > F.col("similarity")) | ((bound == F.col("similarity")) & (F.col("head") < F.col("other")))))
        left = written(open_.groupBy("id", "n", "tokens", "p", "key").agg(F.sum("c").alias("c"), F.collect_list("m").alias("sizes")), "left")
        few = left.filter(F.col("c") <= most).select("id", "n", "tokens", "key", F.explode("sizes").alias("m"))
        pairs = met(few.join(members, ["key", "m"]).filter("id <> other").dropDuplicates(["id", "other"]))
        both = F.size(F.array_intersect("tokens", "there"))
        best = better(best, pairs.select("id", (both / (F.col("n") + F.col("m") - both)).alias("similarity"), "other"))
        # longer lists: one more token, as far as the bound lets its set share enough
        deeper = left.filter(F.col("c") > most).join(best, "id")
        deeper = deeper.select("id", "n", "tokens", "key", "similarity", F.expr("explode(sequence(p + 1, n - 1))").alias("p"))
        deeper = deeper.filter((F.lit(s + 1) + F.col("n") - F.col("p") - 1) / F.col("n") >= F.col("similarity"))
        frontier = written(deeper.select("id", "n", "tokens", "p", F.concat_ws("\x00", "key", F.get("tokens", "p")).alias("key")), "frontier")
        if frontier.isEmpty():
            return best
        long = left.filter(F.col("c") > most).select("key").distinct()
        wanted = frontier.select("key").distinct()
        members = members.join(long, "key", "left_semi").filter("q + 1 < m")
        members = members.select("key", "other", "m", "there", F.expr("explode(sequence(q + 1, m - 1))").alias("q"))
        members = members.withColumn("key", F.concat_ws("\x00", "key", F.get("there", "q"))).join(wanted, "key", "left_semi")
        s += 1


def citation_score(cited: Column, year: Column) -> Column:
    return F.log10(cited + 1) + F.when(year >= RECENT_YEAR, F.when(cited >= 20, 0.6).otherwise(0.2)).otherwise(0.0)


def priority(cited: Column, year: Column, journal_rank: Column, review: Column, topic: Column) -> Column:
    """A, B, C or ''."""
    core, listed = journal_rank == "top", journal_rank.isin("top", "whitelist")
    return (
        F.when(topic == "hard_negative", "C")
        .when((cited >= 800) | ((cited >= 400) & core) | (review & (cited >= 300)) | ((year >= 2025) & (cited >= 80) & core), "A")
        .when((cited >= 150) | (review & (cited >= 60)) | ((year >= RECENT_YEAR) & (cited >= 20)) | ((cited >= 60) & listed) | (cited >= 30), "B")
        .otherwise("")
    )


def paper_type(kind: Column, title: Column) -> Column:
    """review, by the source's word or by the title, else original_research. Fixed value: the pattern."""
    named = F.coalesce(title, F.lit("")).rlike(REVIEW_TITLE)
    return F.when((F.lower(F.coalesce(kind, F.lit(""))) == "review") | named, "review").otherwise("original_research")


def priority_reason(cited: Column, year: Column, journal_rank: Column, review: Column, topic: Column, journal: Column) -> Column:
    """Why a candidate has its priority; '' where it has none. The sentences."""
    n, y = cited.cast("string"), year.cast("string")
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    field = F.coalesce(F.nullif(journal, F.lit("")), F.lit("the field"))
    core, listed = journal_rank == "top", journal_rank.isin("top", "whitelist")
    return (
        F.when(topic == "hard_negative", "Hard negative: topic-similar but answers a different question")
        .when(cited >= 800, say("Landmark classic (", n, " citations), representative work"))
        .when((cited >= 400) & core, say("High-cited (", n, ") in core journal (", journal, ")"))
        .when(review & (cited >= 300), say("Key review (", n, " citations) in ", field))
        .when((year >= 2025) & (cited >= 80) & core, say("Important recent (", y, ") work in ", journal, " (", n, " citations)"))
        .when(cited >= 150, say("Established work (", n, " citations), supplements coverage"))
        .when(review & (cited >= 60), say("Review in ", field, ", broadens topic coverage"))
        .when((year >= RECENT_YEAR) & (cited >= 20), say("Recent (", y, ") work (", n, " citations)"))
        .when((cited >= 60) & listed, say("Moderately cited (", n, ") in ", journal, ", diversifies conditions"))
        .when(cited >= 30, say("Moderately cited (", n, ") work, diversifies materials/routes"))
        .otherwise("")
    )


def composite(score: Column, journal_rank: Column, level: Column) -> Column:
    return score * 3 + F.when(journal_rank == "top", 3.0).when(journal_rank == "whitelist", 1.5).otherwise(0.0) + F.when(level == "A", 2.0).when(level == "B", 1.0).otherwise(0.5)


class _Quota:
    """What one topic's selection has used up so far."""

    def __init__(self, review_cap: int):
        self.rows: list[int] = []
        self.authors: dict[str, int] = {}
        self.journals: dict[str, int] = {}
        self.reviews, self.recent, self.review_cap = 0, 0, review_cap

    def admits(self, w, reviews: bool) -> bool:
        if w.author and self.authors.get(w.author, 0) >= PER_AUTHOR or w.journal and self.journals.get(w.journal, 0) >= PER_JOURNAL:
            return False
        return not (reviews and w.review and self.reviews >= self.review_cap)

    def take(self, i: int, w) -> None:
        self.rows.append(i)
        self.authors[w.author] = self.authors.get(w.author, 0) + 1
        self.journals[w.journal] = self.journals.get(w.journal, 0) + 1
        self.reviews += bool(w.review)
        self.recent += w.year >= RECENT_YEAR


def reachable(candidates: DataFrame, target: int, kind: list[Column]) -> DataFrame:
    """The candidates that a selection of ``target`` picks a topic can come to; their number for a topic has a bound.

    ``kind``: what a pass of the selection asks of a candidate, reviews included. Passes go by score, and caps only fill up,
    so a candidate is picked only if everyone of its kind before it was picked, or has an author or a journal whose cap is
    full. Of one author and journal that are at most as many as an author's cap takes. Of one author there can be as many
    more as the journals that can be full hold, of one journal as the authors that can be full, and of a kind all of these.
    Candidates beyond these numbers are never picked, and who isn't picked changes nothing for the others. An empty author
    or journal has no cap. Each step is a rank with a fixed limit, which Spark cuts before its shuffle too.
    """
    full_authors, full_journals = (target - 1) // PER_AUTHOR, (target - 1) // PER_JOURNAL
    of_author = PER_AUTHOR * (1 + full_journals)
    of_journal = PER_JOURNAL + PER_AUTHOR * full_authors
    of_kind = target + full_authors * of_author + full_journals * of_journal
    author, journal = (F.coalesce(x, F.lit("")) for x in ("author", "journal"))
    rows = candidates.select("*", author.alias("_a"), journal.alias("_j"), F.struct(*kind).alias("_kind"))
    score = F.when(~F.isnan("score"), F.col("score"))
    steps = (
        (["_a", "_j"], F.when(F.col("_a") != "", PER_AUTHOR).when(F.col("_j") != "", PER_JOURNAL).otherwise(target), max(PER_AUTHOR, PER_JOURNAL, target)),
        (["_a", F.when(F.col("_a") == "", F.col("_j"))], F.when(F.col("_a") != "", of_author).otherwise(target), max(of_author, target)),
        (["_j", F.when(F.col("_j") == "", F.col("_a"))], F.when(F.col("_j") != "", of_journal).otherwise(of_kind), max(of_journal, of_kind)),
        ([], F.lit(of_kind), of_kind),
    )
    for keys, own, most in steps:
        place = F.row_number().over(Window.partitionBy("topic", "_kind", *keys).orderBy(score.desc_nulls_last(), "id"))
        rows = rows.withColumn("_n", place).filter((F.col("_n") <= most) & (F.col("_n") <= own)).drop("_n")
    return rows.drop("_a", "_j", "_kind")


def quota_selection(candidates: DataFrame, target: int) -> DataFrame:
    """Candidates chosen by topic in five passes; each pick depends on the ones before, so a topic's reachable ones are one task's work.

    ``candidates``: id, topic, author, journal, year, review, level, score.
    """
    half_even = round
    recent_target, cap = max(2, half_even(target * RECENT_SHARE)), max(2, half_even(target * REVIEW_SHARE))

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rows = list(pool.itertuples(index=False))
        q = _Quota(cap)
        passes = [
            (lambda w: w.level == "A", True, lambda: len(q.rows) >= target - recent_target),
            (lambda w: w.year >= RECENT_YEAR, True, lambda: q.recent >= recent_target or len(q.rows) >= target),
            (lambda w: w.level == "B", True, lambda: len(q.rows) >= target),
            (lambda w: w.topic == "hard_negative", False, lambda: len(q.rows) >= target),
            (lambda w: True, False, lambda: len(q.rows) >= target),
        ]
        for n, (wanted, reviews, full) in enumerate(passes):
            done = set(q.rows)
            for i, w in enumerate(rows):
                if full():
                    break
                if i not in done and wanted(w) and q.admits(w, reviews):
                    q.take(i, w)
            pool.loc[[i for i in q.rows if i not in done], "picked_in"] = n + 1
        return pool.loc[q.rows, ["id", "topic", "score", "picked_in"]].assign(pick=range(1, len(q.rows) + 1)).astype({"picked_in": "int32", "pick": "int32"})

    recent, review = F.coalesce(F.col("year") >= RECENT_YEAR, F.lit(False)), F.coalesce("review", F.lit(False))
    candidates = reachable(candidates, target, [F.col("level").alias("level"), recent.alias("recent"), review.alias("review")])
    return candidates.groupBy("topic").applyInPandas(lambda pool: choose(pool.assign(picked_in=0)), "id long, topic string, score double, picked_in int, pick int")


def trim_selection(candidates: DataFrame, quota: int) -> DataFrame:
    """Candidates chosen by topic for the main list: recent ones first, up to their share, then by score; a topic's reachable ones are one task's work.

    ``candidates`` as in ``quota_selection``; hard negatives are chosen elsewhere. The same caps on authors, journals and
    reviews hold in both passes.
    """
    recent_target, cap = max(2, round(quota * RECENT_SHARE)), max(2, round(quota * REVIEW_SHARE))

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rows = list(pool.itertuples(index=False))
        q, recent = _Quota(cap), 0
        for wanted_recent in (True, False):
            done = set(q.rows)
            for i, w in enumerate(rows):
                if len(q.rows) >= quota or wanted_recent and recent >= recent_target:
                    break
                if i not in done and (not wanted_recent or w.year >= TRIM_RECENT_YEAR) and q.admits(w, True):
                    q.take(i, w)
                    recent += wanted_recent
        return pool.loc[q.rows, ["id", "topic", "score"]]

    late, review = F.coalesce(F.col("year") >= TRIM_RECENT_YEAR, F.lit(False)), F.coalesce("review", F.lit(False))
    candidates = reachable(candidates.filter("topic <> 'hard_negative'"), quota, [late.alias("recent"), review.alias("review")])
    return candidates.groupBy("topic").applyInPandas(choose, "id long, topic string, score double")


def trimmed(candidates: DataFrame, selected: DataFrame, existing: DataFrame, hard_quota: int) -> DataFrame:
    """id, list, reason of every candidate: main list A or B, C for the most cited hard negatives, reserve, or rejected and why.

    ``existing``: the ids whose papers are there already. The best 70 % of a topic's selection are A; the reserve are the
    best of the others, few of each topic.
    """
    by_score = Window.partitionBy("topic").orderBy(F.desc("score"), "id")
    n = F.count("*").over(Window.partitionBy("topic"))
    main = selected.withColumn("list", F.when(F.row_number().over(by_score) <= F.bround(n * A_SHARE), "A").otherwise("B")).select("id", "list")
    there = existing.select("id").distinct().withColumn("_there", F.lit(True))
    rows = candidates.select("id", "topic", "score", "cited").join(main, "id", "left").join(there, "id", "left")
    hard = rows.filter("topic = 'hard_negative' and _there is null").orderBy(F.desc("cited"), "id").limit(hard_quota).select("id", F.lit("C").alias("_hard"))
    rows = rows.join(hard, "id", "left")
    others = rows.filter("list is null and _there is null and topic <> 'hard_negative'")
    few = others.withColumn("_n", F.row_number().over(by_score)).filter(F.col("_n") <= RESERVE_PER_TOPIC)
    reserve = few.orderBy(F.desc("score"), "id").limit(RESERVE).select("id", F.lit("reserve").alias("_reserve"))
    rows = rows.join(reserve, "id", "left")
    where = F.coalesce("list", "_hard", "_reserve", F.lit("rejected"))
    reason = F.when(where != "rejected", "").when(F.col("_there"), "duplicate_of_existing_corpus").when(F.col("topic") == "hard_negative", "hn_quota_exceeded").otherwise("quota_exceeded")
    return rows.select("id", where.alias("list"), reason.alias("reason"))


def numbered(rows: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """``rows`` with their number (from 1) in an order of all: ranges are sorted apart, and only their counts come together.

    The order has to be total, or equal rows get any of their numbers. Rows are written once, as ranges come from a sample.
    """
    spark = rows.sparkSession
    place = fresh_place(spark, "numbered")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")).write.parquet(place)
    held = spark.read.parquet(place)
    before = F.sum("_m").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.groupBy("_range").agg(F.count("*").alias("_m")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    return held.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_i") + 1).drop("_range", "_start", "_i")


def hard_negative(title: Column) -> Column:
    """'' for a valid hard negative, else why it isn't."""
    return (
        F.when(title.rlike(HN_OFF_TOPIC), "hn_off_topic(soil/epidemiology/non-water)").when(~title.rlike(HN_WATER), "hn_off_topic(not water-related)")
        .when(title.rlike(HN_KEEP), "").when(title.rlike(HN_TREATMENT), "hn_answers_same_question(is a treatment paper)").otherwise("hn_not_occurrence_type")
    )


def work_fields(body: Column) -> Column:
    """first_author and journal of a catalogue's record in JSON; '' for what's missing, null or empty."""
    record = F.from_json(body, "authorships array<struct<author: struct<display_name: string>>>, host struct<name: string>")
    author = F.coalesce(F.get(record["authorships"], 0)["author"]["display_name"], F.lit(""))
    return F.struct(author.alias("first_author"), F.coalesce(record["host"]["name"], F.lit("")).alias("journal"))


def triage(downloads: DataFrame, corpus: DataFrame, tracked: DataFrame) -> DataFrame:
    """Downloads (id, sha, doi, ok) with their bucket; the first rule that holds wins."""
    shas = corpus.select("sha", F.lit(True).alias("has_sha")).distinct()
    dois = corpus.filter("doi <> ''").select("doi", F.lit(True).alias("has_doi")).distinct()
    known = tracked.filter("doi <> ''").select("doi", F.lit(True).alias("wanted")).distinct()
    rows = downloads.join(shas, "sha", "left").join(dois, "doi", "left").join(known, "doi", "left")
    bucket = F.when(~F.col("ok"), "rejected").when(F.col("has_sha"), "duplicate_sha").when(F.col("has_doi"), "duplicate_doi").when(F.col("wanted"), "matched").when(F.col("doi") != "", "untracked").otherwise("unresolved")
    return rows.select("id", bucket.alias("bucket"))


def first_rule(c: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The label of the first pattern that matches."""
    out = F.lit(default)
    for label, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), label).otherwise(out)
    return out
