"""How papers are got: access, routes by DOI, versions, channels, lists for download and their bibliographies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Publishers, DOI prefixes with their routes, versions in order, and the tags of bibliographies.
PUBLISHERS = ("elsevier", "springer", "wiley", "acs", "rsc", "mdpi", "taylor")
ROUTES = (
    ("10.1016/", "校园网 ScienceDirect 人工下载"), ("10.1021/", "校园网 ACS Publications 人工下载"), ("10.1002/", "校园网 Wiley 人工下载"),
    ("10.1007/", "校园网 Springer 人工下载"), ("10.1039/", "校园网 RSC 人工下载"),
)
OTHER_ROUTE = "CASHL/CALIS 文献传递"
PUBLISHER_PAGE, PUBLISHER_PREFIXES = "校园网出版社页面人工下载", ("10.1021/", "10.1002/", "10.1007/", "10.1039/", "10.1111/", "10.1080/")
VERSIONS = ("publishedVersion", "acceptedVersion")
RIS = (("TI", "title"), ("PY", "year"), ("JO", "journal"), ("T2", "journal"), ("DO", "doi"), ("UR", "url"), ("KW", "topic"))
ENW = (("%T", "title"), ("%D", "year"), ("%J", "journal"), ("%R", "doi"), ("%U", "url"), ("%K", "topic"))


def doi_url(doi: Column) -> Column:
    return F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise("")


def access(oa_url: Column, journal: Column, journal_rank: Column, doi: Column) -> Column:
    """Struct of status and url: open, by an institution's subscription, by hand, or unknown."""
    of = F.lower(F.coalesce(journal, F.lit("")))
    big = F.exists(F.array(*map(F.lit, PUBLISHERS)), lambda p: F.contains(of, p))
    held = lambda c: F.coalesce(c, F.lit("")) != ""
    answer = lambda status, url: F.struct(F.lit(status).alias("status"), url.alias("url"))
    return (
        F.when(held(oa_url), answer("open_access", oa_url))
        .when(F.coalesce(journal_rank.isin("top", "whitelist"), F.lit(False)) | big, answer("institution_access_possible", doi_url(doi)))
        .when(held(doi), answer("manual_required", doi_url(doi)))
        .otherwise(answer("unknown", F.lit("")))
    )


def route(doi: Column, by_publisher: bool = False) -> Column:
    """By whom a DOI's paper can be had; with ``by_publisher`` the shorter table of the publishers' own pages."""
    low = F.lower(F.coalesce(doi, F.lit("")))
    out = F.lit(OTHER_ROUTE)
    table = ((ROUTES[0][0], ROUTES[0][1]), *((p, PUBLISHER_PAGE) for p in PUBLISHER_PREFIXES)) if by_publisher else ROUTES
    for prefix, name in reversed(table):
        out = F.when(low.startswith(prefix), name).otherwise(out)
    return out


def best_location(locations: Column) -> Column:
    """Of an array of (version, url) the url of the best version: published, accepted, any; null without urls."""
    usable = F.filter(locations, lambda x: F.coalesce(x["url"], F.lit("")) != "")
    ranked = F.transform(usable, lambda x, i: F.struct(
        F.when(x["version"] == VERSIONS[0], 0).when(x["version"] == VERSIONS[1], 1).otherwise(2).alias("rank"), i.alias("i"), x["url"].alias("url")
    ))
    return F.array_min(ranked)["url"]


def first_channel(channels: list[tuple[str, Column]]) -> Column:
    """Struct of channel and reasons: the first channel whose file has no problem ('' is none, null is no file), else manual."""
    passed = [F.when(problem == "", F.lit(name)) for name, problem in channels]
    tried = F.array_compact(F.array(*(F.when(problem != "", F.concat(F.lit(f"{name}:"), problem)) for name, problem in channels)))
    return F.struct(F.coalesce(*passed, F.lit("manual")).alias("channel"), F.array_join(tried, ";").alias("reasons"))


def noted_score(notes: Column) -> Column:
    """The number in notes like ``score=1.5; ...``, 0 where there is none."""
    first = F.get(F.split(F.coalesce(notes, F.lit("")), ";"), 0)
    return F.coalesce(F.get(F.split(first, "="), 1).try_cast("double"), F.lit(0.0))


def wanted_first(rows: DataFrame, n: int = 40) -> DataFrame:
    """The ``n`` best of level A that aren't openly accessible."""
    return rows.filter((F.col("level") == "A") & (F.col("access") != "open_access")).orderBy(F.desc("score"), "id").limit(n)


def hard_negatives(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` most cited hard negatives with their place."""
    w = Window.orderBy(F.desc("cited"), "id")
    return rows.orderBy(F.desc("cited"), "id").limit(n).withColumn("place", F.row_number().over(w))


def bibliography(rows: DataFrame) -> DataFrame:
    """id, ris, enw: tagged records of (id, title, year, journal, doi, url, topic, priority, route); empty fields have no line."""
    text = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " "))
    rows = rows.withColumn("url", F.when(text("url") != "", text("url")).otherwise(doi_url(F.col("doi"))))
    note = F.concat(F.lit("Priority "), text("priority"), F.lit(" | "), text("route"))

    def record(first: str, tags, join: str, note_tag: str, last: list[str]) -> Column:
        lines = [F.when((text(c) != "") | F.lit(c == "title"), F.concat(F.lit(f"{tag}{join}"), text(c))) for tag, c in tags]
        return F.concat_ws("\n", F.lit(first), *lines, F.concat(F.lit(f"{note_tag}{join}"), note), *map(F.lit, last))

    return rows.select("id", record("TY  - JOUR", RIS, "  - ", "N1", ["ER  - "]).alias("ris"), record("%0 Journal Article", ENW, " ", "%1", []).alias("enw"))


def export_order(rows: DataFrame) -> DataFrame:
    """Rows with their place in a bibliography: by priority (none is last), topic and year."""
    w = Window.orderBy(F.coalesce("priority", F.lit("Z")), F.coalesce("topic", F.lit("")), F.coalesce("year", F.lit(0)), "id")
    return rows.withColumn("place", F.row_number().over(w))
