"""Text functions from built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters and their plain forms, and punctuation with its ASCII forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāēīōūćčďěłńňřśšťůźżžő"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaeiouccdelnnrsstuzzzo"
CURLY = "‘’‚“”„–— "
STRAIGHT = "'''\"\"\"-- "


def collapse(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def fold_name(text: Column) -> Column:
    """Lower case without accents, white space collapsed."""
    return collapse(F.translate(F.lower(text), ACCENTED, PLAIN))


def clean_name(text: Column) -> Column:
    """A name without brackets and titles, "Surname, Given" turned round."""
    bare = F.regexp_replace(text, r"\([^)]*\)", "")
    bare = F.regexp_replace(bare, r"(?i)^( *(rt hon|hon|dr|mr|mrs|ms|sir|dame)\.? +)+", "")
    turned = F.when(bare.contains(","), F.concat(F.split_part(bare, F.lit(","), F.lit(2)), F.lit(" "), F.split_part(bare, F.lit(","), F.lit(1)))).otherwise(bare)
    return collapse(turned)


def fold_punctuation(text: Column) -> Column:
    return F.replace(F.translate(text, CURLY, STRAIGHT), F.lit("…"), F.lit("..."))


def quote_key(text: Column) -> Column:
    """Identity of a quote: folded, lower case, white space collapsed, punctuation at the ends cut."""
    return F.regexp_replace(F.lower(collapse(fold_punctuation(text))), r"^[ .,;:!?'\"()-]+|[ .,;:!?'\"()-]+$", "")


def title_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold_name(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def template_key(text: Column) -> Column:
    """Text with every number as #, lower case, white space collapsed."""
    return F.regexp_replace(F.lower(collapse(text)), r"[0-9][0-9,.]*", "#")


def tidy(text: Column) -> Column:
    """Spaces at line ends cut, runs of spaces single, at most one blank line in a row."""
    text = F.regexp_replace(text, "[ \t]+", " ")
    text = F.regexp_replace(text, " ?\n ?", "\n")
    return F.trim(F.regexp_replace(text, "\n{3,}", "\n\n"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(collapse(text), r"(?<=[.!?]) "), lambda s: s != "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\n\r\f]+"), lambda w: w != "")


def shingles(tokens: Column, k: int) -> Column:
    """Runs of ``k`` tokens, joined by spaces; none where there are fewer."""

    def cut(t: Column) -> Column:  # inside a lambda, so that the tokens are made once and not for every run
        starts = F.when(F.size(t) >= k, F.sequence(F.lit(1), F.size(t) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, k), " "))

    return F.element_at(F.transform(F.array(tokens), cut), 1)


def without_lines(text: Column, pattern: str) -> Column:
    """Text without the lines that match, and without URLs."""
    lines = F.filter(F.split(text, "\n"), lambda line: ~F.lower(line).rlike(pattern))
    return F.regexp_replace(F.array_join(lines, "\n"), r"https?://[^ \n]+", "")


def quote_class(quote: Column, source: Column) -> Column:
    """verbatim, spliced (all parts between ellipses, of 25 characters or more, are there) or missing."""
    q, s = quote_key(quote), quote_key(source)
    parts = F.filter(F.transform(F.split(q, r"\.\.\."), lambda p: F.trim(p)), lambda p: F.length(p) >= 25)
    spliced = (F.size(parts) > 0) & F.forall(parts, lambda p: F.contains(s, p)) & F.contains(q, F.lit("..."))
    return F.when(F.contains(s, q), "verbatim").when(spliced, "spliced").otherwise("missing")


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]+)", 1)), r"^www\.", "")


def score_key(text: Column) -> Column:
    """Content address: first 16 hexadecimal digits of sha-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def hash_bucket(text: Column, buckets: int) -> Column:
    """First 8 hexadecimal digits of sha-256, modulo ``buckets``."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def first_date(text: Column) -> Column:
    """First valid YYYY-MM-DD in a text, else NULL."""
    return F.try_to_date(F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0))


def long_date(text: Column) -> Column:
    """"18 June 2026", "Jun 18, 2026" or "18/6/2026" as a date, else NULL."""
    day_first = F.regexp_extract(text, r"(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4})", 0)
    month_first = F.regexp_extract(text, r"([A-Za-z]{3})[a-z]* (\d{1,2}), ?(\d{4})", 0)
    short = lambda t, pattern, to: F.regexp_replace(t, pattern, to)
    return F.coalesce(
        F.try_to_date(short(day_first, r"^(\d{1,2}) ([A-Za-z]{3})[a-z]* ", "$1 $2 "), "d MMM yyyy"),
        F.try_to_date(short(month_first, r"^([A-Za-z]{3})[a-z]* (\d{1,2}), ?", "$2 $1 "), "d MMM yyyy"),
        F.try_to_date(F.regexp_extract(text, r"\d{1,2}/\d{1,2}/\d{4}", 0), "d/M/yyyy"),
    )


def url_date(url: Column) -> Column:
    """Date in a path such as /2026/6/18/ or /18-6-2026/, else NULL."""
    return F.coalesce(F.try_to_date(F.regexp_extract(url, r"/(\d{4}/\d{1,2}/\d{1,2})(/|$)", 1), "yyyy/M/d"), F.try_to_date(F.regexp_extract(url, r"/(\d{1,2}-\d{1,2}-\d{4})(/|$)", 1), "d-M-yyyy"))


def json_array(text: Column) -> Column:
    """The JSON array in fenced or wordy text."""
    return F.regexp_extract(text, r"(?s)\[.*\]", 0)
