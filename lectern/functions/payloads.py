"""What the answer of a full-text service holds: marks of structure in XML or HTML, fields and kinds in JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marks:
    """Strings that show a payload's structure. The defaults are fixed values of a full-text service's XML."""

    sections: str = "<ce:sections"
    paragraph: str = "<ce:para"
    abstracts: tuple[str, ...] = ("<ce:abstract", "<abstract")
    full_text: str = "full-text-retrieval-response"
    title: tuple[str, str] = ("<dc:title>", "</dc:title>")


#: The same for web pages.
HTML = Marks("<article", "<p>", ("<h1", "<h2"), "<body", ("<title>", "</title>"))
#: The answers of a full-text service and of its abstracts, and how much of a title is shown.
ARTICLE, ABSTRACT, TITLE = "full-text-retrieval-response", "abstracts-retrieval-response", 80


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def markup_signals(payload: Column, marks: Marks = Marks()) -> Column:
    """Struct: has_sections, paragraphs, has_abstract, core_only (nothing of the full text), first_title (its first 80 characters).

    A null payload holds nothing. A title without an end goes to the end of the payload.
    """
    p = _text(payload)
    behind = F.get(F.split(p, rf"\Q{marks.title[0]}\E", 2), 1)
    title = F.get(F.split(behind, rf"\Q{marks.title[1]}\E", 2), 0)
    return F.struct(
        p.contains(marks.sections).alias("has_sections"), F.regexp_count(p, F.lit(rf"\Q{marks.paragraph}\E")).alias("paragraphs"),
        F.exists(F.array(*map(F.lit, marks.abstracts)), lambda a: F.contains(p, a)).alias("has_abstract"),
        (~p.contains(marks.full_text)).alias("core_only"), F.substring(_text(title), 1, TITLE).alias("first_title"),
    )


def json_signals(payload: Column, marks: Marks = Marks()) -> Column:
    """Struct: kind (article, abstract, or null where it isn't a JSON object), title, has_abstract, open_access, access_fields
    (names with entitl or access in them, in order), text_length, has_sections, paragraphs (of an article's text, else null)."""
    answer = lambda name: F.get_json_object(payload, f"$['{name}']")
    keys = F.json_object_keys(payload)
    article = answer(ARTICLE).isNotNull()
    core = F.get_json_object(F.when(article, answer(ARTICLE)).otherwise(answer(ABSTRACT)), "$.coredata")
    field = lambda name: F.get_json_object(core, f"$['{name}']")
    text = F.when(article, _text(F.get_json_object(answer(ARTICLE), "$.originalText")))
    names = F.filter(F.coalesce(F.json_object_keys(core), F.array().cast("array<string>")), lambda k: F.lower(k).rlike("entitl|access"))
    return F.struct(
        F.when(keys.isNotNull(), F.when(article, "article").otherwise("abstract")).alias("kind"), F.substring(_text(field("dc:title")), 1, TITLE).alias("title"),
        (_text(field("dc:description")) != "").alias("has_abstract"), field("openaccess").alias("open_access"), names.alias("access_fields"),
        F.length(text).alias("text_length"), text.contains(marks.sections).alias("has_sections"),
        F.regexp_count(text, F.lit(rf"\Q{marks.paragraph}\E")).alias("paragraphs"),
    )
