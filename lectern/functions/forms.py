"""Unicode normal forms as Column expressions: compatibility decomposition and case folding, without Python workers.

The tables come from ``unicodedata`` when the module is loaded. A text is cut into runs of ASCII, which neither form needs
a table for, and single other characters; of these, each one's image is put together from its first character, its second
and so on, each looked up by ``translate``. Texts of ASCII alone aren't cut.
"""

from __future__ import annotations

import string
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"[\x00-\x7F]+|[^\x00-\x7F]"


#: Forms: all characters; those that texts in alphabets are made of (below the ideographs, and presentation forms); those that
#: leave an ASCII letter or digit.
ALL, ALPHABETS, ALNUM = "all", "alphabets", "alnum"


@cache
def _images(form: str) -> dict[str, str]:
    """The characters beyond ASCII that a form changes, with what it makes of them."""
    change: Callable[[str], str] = str.casefold if form == "casefold" else lambda x: unicodedata.normalize("NFKD", x)
    every = (chr(i) for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    images = {x: y for x in every if (y := change(x)) != x}
    if form == ALPHABETS:
        return {x: y for x, y in images.items() if x < "\u2c00" or "\ufb00" <= x < "\ufb50" or "\uff00" <= x <= "\uffff"}
    if form in (ALL, "casefold"):
        return images
    return {x: y for x, y in images.items() if any(z.isascii() and z.isalnum() for z in y)}


@cache
def _steps(form: str) -> list[tuple[str, str, str]]:
    """For each place of an image: a pattern of the characters that have it, these characters, and theirs at that place."""
    images, out = _images(form), []
    for place in range(max(map(len, images.values()))):
        some = {x: y[place] for x, y in images.items() if len(y) > place}
        out.append((_any_of(sorted(some)), "".join(some), "".join(some.values())))
    return out


def _any_of(characters: list[str]) -> str:
    """A character class of ranges."""
    ranges: list[list[int]] = []
    for x in map(ord, characters):
        if ranges and x == ranges[-1][1] + 1:
            ranges[-1][1] = x
        else:
            ranges.append([x, x])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


@cache
def _cased() -> str:
    """A pattern of the characters beyond ASCII that folding or lower case changes; ASCII is passed over without the class."""
    every = (chr(i) for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    return r"(?=[^\x00-\x7F])" + _any_of([x for x in every if x.casefold() != x or x.lower() != x])


def _mapped(c: Column, form: str, plain: Callable[[Column], Column]) -> Column:
    def image(x: Column) -> Column:
        (_, before, after), *more = _steps(form)
        ends = [F.when(x.rlike(pattern), F.translate(x, have, give)).otherwise("") for pattern, have, give in more]
        # most characters have one more at most: the rest is asked for only where there's a second
        end = F.when(x.rlike(more[0][0]), F.concat(*ends)).otherwise("") if more else F.lit("")
        return F.when(x < "\x80", plain(x)).otherwise(F.concat(F.translate(x, before, after), end))

    def form_of(x: Column) -> Column:
        whole = F.array_join(F.transform(F.regexp_extract_all(x, F.lit(_PARTS), F.lit(0)), image), "")
        return F.when(x.rlike(r"[^\x00-\x7F]"), whole).otherwise(plain(x))

    return F.get(F.transform(F.array(c), form_of), 0)  # the text is made once, however often it's looked at


def nfkd(c: Column, form: str = ALL) -> Column:
    """Compatibility decomposition, character by character; several marks on one character stay in their order."""
    return _mapped(c, form, lambda x: x)


def casefolded(c: Column) -> Column:
    """Full case folding. Only a text with a character that becomes several, other than sharp s, is cut.

    Where no character beyond ASCII changes, as in most decomposed texts, lower case is the same and much cheaper.
    """
    single = {x: y for x, y in _images("casefold").items() if len(y) == 1}
    several = sorted(x for x in _images("casefold") if x not in single and x != "ß")

    def plain(x: Column) -> Column:
        return F.translate(F.translate(x, string.ascii_uppercase, string.ascii_lowercase), "".join(single), "".join(single.values()))

    def fold(x: Column) -> Column:
        full = F.when(x.rlike(_any_of(several)), _mapped(x, "casefold", F.lower)).otherwise(plain(x))
        return F.when(x.rlike(_cased()), full).otherwise(F.lower(x))

    return F.get(F.transform(F.array(F.replace(c, F.lit("ß"), F.lit("ss"))), fold), 0)
