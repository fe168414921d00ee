"""Projections of records: outcomes, scores, links, dates and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import collapse, fold_name


def outcome(assent: Column, status: Column) -> Column:
    """enacted once there is assent (whatever the status says), terminated, else in_progress."""
    low = F.lower(F.coalesce(status, F.lit("")))
    return F.when(assent.isNotNull() & (assent != ""), "enacted").when(low.rlike("terminat|withdrawn|defeated|discharged|lapsed"), "terminated").otherwise("in_progress")


def in_term(parliament: Column, number: int, dates: Column, start: str) -> Column:
    """Of the parliament, or with any date of the array on or after the start."""
    return F.coalesce(parliament == number, F.lit(False)) | F.exists(F.coalesce(dates, F.array().cast("array<string>")), lambda d: F.coalesce(F.substring(d, 1, 10) >= start, F.lit(False)))


def by_date(structs: Column, field: str = "date") -> Column:
    """Array of structs in order of a date, those without one first."""
    key = lambda x: F.coalesce(x[field], F.lit(""))
    return F.array_sort(structs, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def is_pending(reply: Column) -> Column:
    """A reply that is missing or only says that one will follow."""
    return reply.isNull() | F.lower(collapse(reply)).rlike(r"^$|^(reply|answer) (due|pending)|^this question has been .*transferred")


def labelled(parts: list[tuple[str, Column]]) -> Column:
    """"Label: value" blocks, without the missing ones."""
    return F.concat_ws("\n\n", *(F.when(c.isNotNull() & (F.trim(c) != ""), F.concat(F.lit(f"{label}: "), c)) for label, c in parts))


def value_of(key: Column, values: dict[str, float]) -> Column:
    """Score of a verdict; unknown verdicts have none."""
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def live_or_archived(url: Column, live: Column, stamp: str = "2", archive: str = "https://web.archive.org/web") -> Column:
    """The URL, or its archived copy where it is known to be dead."""
    return F.when(F.coalesce(live, F.lit(True)), url).otherwise(F.concat(F.lit(f"{archive}/{stamp}/"), url))


def url_state(status: Column) -> Column:
    """live (200), dead (404, 410), else unknown."""
    return F.when(status == 200, "live").when(status.isin(404, 410), "dead").otherwise("unknown")


def first_keyword(text: Column, keywords: list[tuple[str, str]]) -> Column:
    """Name of the first keyword that the text holds."""
    out = F.lit(None).cast("string")
    for word, name in reversed(keywords):
        out = F.when(F.contains(F.lower(text), F.lit(word.lower())), name).otherwise(out)
    return out


def band(score: Column, default: int, low: int = 1, high: int = 10) -> Column:
    """A score of 0 to 100 in a whole band, half-even, clamped; the default where there is none."""
    return F.when(score.isNull(), default).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.bround(score / (100 / high)).cast("int"))))


def clamp(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Clamped score; NULL stays."""
    return F.when(score.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), score)))


def subject(value: Column, can_be_other: Column) -> Column:
    """Whom a statement is about: the speaker, unless the attribute allows others and one is named."""
    return F.when(~can_be_other | value.isNull(), "speaker").when(value.isin("speaker", "other"), value).otherwise("speaker")


def without_honorifics(name: Column) -> Column:
    return F.regexp_replace(fold_name(name), r"^((rt hon|right hon|hon|dr|sir|dame|mr|mrs|ms) )+", "")


def split_id(id_: Column) -> Column:
    """struct<window, attribute, idx> of "window|attribute|idx", any "@model" cut; NULL where it hasn't three parts."""
    parts = F.split(F.regexp_replace(id_, "@[^|]*$", ""), r"\|")
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("window"), parts[1].alias("attribute"), F.expr("1").alias("one")).dropFields("one").withField("idx", parts[2].try_cast("int")))


def prefixed(map_: Column, prefix: str) -> Column:
    """Entries of a map whose keys begin with the prefix, without it."""
    return F.transform_keys(F.map_filter(map_, lambda k, _: k.startswith(prefix)), lambda k, _: F.substring(k, len(prefix) + 1, 1 << 20))


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def cutoff(reference: Column, months: int) -> Column:
    """Day of 30 days a month before the reference."""
    return F.date_sub(reference, 30 * months)


def recent_or_undated(date: Column, since: Column) -> Column:
    return date.isNull() | (date >= since)


def month_starts(first: Column, last: Column) -> Column:
    """First days of the months that half-open ranges of a month begin with."""
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH"))


def weekdays_back(last: Column, days: int) -> Column:
    """The weekdays of so many days up to the last, latest first."""
    return F.reverse(F.filter(F.sequence(F.date_sub(last, days - 1), last), lambda d: F.weekday(d) < 5))


def night(ts: Column) -> Column:
    """Day on which the night of a time ends."""
    return F.to_date(ts - F.expr("INTERVAL 12 HOURS"))


def hour_window(hour: Column, start: int, end: int) -> Column:
    """Whether an hour lies in a window that may pass midnight."""
    return (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)


def months_between_at_least_one(first: Column, last: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.datediff(last, first) / 30) + 1).cast("int")


def absolute_url(href: Column, base: str) -> Column:
    """A link made absolute against a site's root."""
    root = base.rstrip("/")
    return F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(F.lit(root), href)).otherwise(F.concat(F.lit(root + "/"), href))


def sub_links(links: DataFrame, url: str, root: str, path_pattern: str, most_slashes: int = 4) -> DataFrame:
    """Links of the root's host whose path fits and isn't deep, once each."""
    host = lambda c: F.lower(F.regexp_extract(c, r"^https?://([^/:?#]+)", 1))
    path = F.regexp_extract(url, r"^https?://[^/]+([^?#]*)", 1)
    fits = (host(F.col(url)) == host(F.lit(root))) & path.rlike(path_pattern) & (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) <= most_slashes)
    return links.where(fits).select(F.regexp_replace(url, "#.*$", "").alias(url)).distinct()


def lead_and_rest(text: Column, most: int) -> Column:
    """struct<lead, rest>: the text cut at the last space before ``most`` characters."""
    head = F.substring(text, 1, most)
    at = F.length(head) - F.locate(" ", F.reverse(head)) + 1
    cut = F.when(F.length(text) <= most, F.length(text)).when(F.locate(" ", head) == 0, F.lit(most)).otherwise(at - 1)
    return F.struct(F.substring(text, F.lit(1), cut).alias("lead"), F.ltrim(F.substring(text, cut + 1, F.length(text))).alias("rest"))


def front_matter(text: Column) -> Column:
    """Map of the "key: value" lines at a note's head, between lines of dashes."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))), F.trim(F.regexp_replace(x, "^[^:]*:", "")))))


def same_person(a: Column, b: Column) -> Column:
    """Equal names, or equal surnames."""
    last = lambda c: F.element_at(F.split(without_honorifics(c), " "), -1)
    return (without_honorifics(a) == without_honorifics(b)) | (last(a) == last(b))


def polar(value: Column, place: Column, places: Column, radius: float = 100.0) -> Column:
    """struct<x, y> of a value of 0 to 100 on a radar's spoke, the first one upwards."""
    angle = 2 * 3.141592653589793 * place / places - 3.141592653589793 / 2
    return F.struct((radius * value / 100 * F.cos(angle)).alias("x"), (radius * value / 100 * F.sin(angle)).alias("y"))


def leading_class(note: Column) -> Column:
    """The class that a note begins with: its text before the first semicolon, lower-cased; NULL where there is none."""
    name = F.lower(F.trim(F.split_part(note, F.lit(";"), F.lit(1))))
    return F.when(name != "", name)
