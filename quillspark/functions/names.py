"""Names of people as transcripts print them."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles in front of names.
TITLES = ["Right Honourable", "Rt Hon", "Honourable", "Hon", "Sir", "Dame", "Dr", "Mr", "Mrs", "Ms", "Miss"]


@cache
def _bare_letters() -> tuple[str, str]:
    """Latin letters with marks and the plain letter of each, by their decomposition."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case, plain letters for Latin ones with marks, single spaces; loose marks go."""
    plain = F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), *_bare_letters())
    return F.trim(F.regexp_replace(F.lower(plain), r"(?U)\s+", " "))


def clean(text: Column) -> Column:
    """The person of a speaker's tag: without brackets, titles and on whose behalf they speak, "Surname,
    Given" turned round, and words in capitals with a capital first letter only."""
    bare = F.regexp_replace(text, r"\([^()]*\)|[()]", " ")
    bare = F.regexp_replace(bare, r"(?i)\s+on behalf of\b.*$", "")
    bare = F.regexp_replace(F.trim(bare), rf"(?i)^(?:(?:{'|'.join(TITLES)})\b\.?\s*)+", "")
    comma = F.locate(",", bare)
    turned = F.when(comma > 0, F.concat(F.trim(F.substring_index(bare, ",", -1)), F.lit(" "), F.trim(F.substring_index(bare, ",", 1)))).otherwise(bare)
    part = lambda p: F.when((F.length(p) > 1) & (p == F.upper(p)), F.initcap(p)).otherwise(p)
    word = lambda w: F.array_join(F.transform(F.split(w, "-"), part), "-")
    return F.array_join(F.transform(F.split(F.trim(F.regexp_replace(turned, r"(?U)\s+", " ")), " "), word), " ")


def same_person(a: Column, b: Column) -> Column:
    """Equal folded clean names, or equal surnames; false where a name is empty or NULL."""
    x, y = fold(clean(a)), fold(clean(b))
    last = lambda c: F.element_at(F.split(c, " "), -1)
    return F.coalesce((x != "") & (y != "") & ((x == y) | (last(x) == last(y))), F.lit(False))
