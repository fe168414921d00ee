"""Rosters: people with stable ids and aliases, and looser joins by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import names

_COLUMNS = ["id", "name", "party", "aliases"]


def slug(name: Column) -> Column:
    """Folded words joined by hyphens."""
    return F.trim(F.regexp_replace(names.fold(name), r"[^a-z0-9]+", "-"), F.lit("-"))


def title_key(title: Column) -> Column:
    """Letters and digits of a title in lower case."""
    return F.regexp_replace(F.lower(title), "[^a-z0-9]+", "")


def rebuild(members: DataFrame, existing: DataFrame) -> DataFrame:
    """``id, name, party, aliases`` of the members (``name, party``) anew.

    A member whose folded name is a full-name alias (one of several words) of an entry of
    ``existing`` keeps that entry's id and aliases; of several such entries the last by id counts.  Others
    get a slug.  The folded name and the surname are aliases of everyone.  Of members of one folded name the
    first by name and party stays; members without a name are left out.
    """
    key = names.fold(F.col("name"))
    people = members.select("name", "party", key.alias("key")).where("key <> ''").groupBy("key").agg(F.min(F.struct("name", "party")).alias("m"))
    known = existing.select("id", "aliases", F.explode("aliases").alias("key")).where(F.contains("key", F.lit(" "))).groupBy("key").agg(F.max(F.struct("id", "aliases")).alias("e"))
    own = F.array("key", F.element_at(F.split("key", " "), -1))
    joined = people.join(known, "key", "left")
    aliases = F.array_sort(F.array_union(own, F.coalesce("e.aliases", F.array().cast("array<string>"))))
    return joined.select(F.coalesce("e.id", slug(F.col("m.name"))).alias("id"), F.col("m.name").alias("name"), F.col("m.party").alias("party"), F.array_distinct(aliases).alias("aliases"))


def views(roster: DataFrame) -> DataFrame:
    """``id, full_names, surnames``: aliases of several words and of one."""
    has = lambda a: F.contains(a, F.lit(" "))
    return roster.select("id", F.filter("aliases", has).alias("full_names"), F.filter("aliases", lambda a: ~has(a)).alias("surnames"))


def index(roster: DataFrame) -> DataFrame:
    """``key, id`` of the aliases that lead to one person only."""
    aliases = roster.select("id", F.explode("aliases").alias("a")).select("id", names.fold(F.col("a")).alias("key")).where("key <> ''")
    return aliases.groupBy("key").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")).where("n = 1").drop("n")


def resolve_forms(rows: DataFrame, forms: list[str], roster: DataFrame, into: str = "id") -> DataFrame:
    """``rows`` with the person that the first of several name forms leads to; NULL if none does.

    A form is looked up by its clean folded name, then by its last word; names that several
    people share lead nowhere.
    """
    known = index(roster)
    wrapped = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
    found = []
    for k, form in enumerate(forms):
        key = names.fold(names.clean(F.col(f"row.`{form}`")))
        for j, c in enumerate((key, F.element_at(F.split(key, " "), -1))):
            name = f"f{k}_{j}"
            wrapped = wrapped.join(known.select(F.col("key").alias(f"k_{name}"), F.col("id").alias(name)), c == F.col(f"k_{name}"), "left")
            found.append(F.col(name))
    return wrapped.select("row.*", F.coalesce(*found).alias(into))


def loose_join(rows: DataFrame, keys: list[str], table: DataFrame, table_keys: list[str], keep: list[str]) -> DataFrame:
    """``rows`` with ``keep`` of the table's entry that any of its keys names, without regard to case.

    The keys of a row are tried in their order.  An entry is known by each of ``table_keys`` that isn't
    empty; of entries with one key the last by ``table_keys`` counts.
    """
    entry = F.struct(*(F.col(f"`{c}`") for c in [*table_keys, *keep]))
    named = table.select(entry.alias("e"), F.explode(F.array(*(F.lower(F.col(f"`{c}`").cast("string")) for c in table_keys))).alias("key")).where("key <> ''").groupBy("key").agg(F.max("e").alias("e"))
    out = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
    for k, c in enumerate(keys):
        out = out.join(named.select(F.col("key").alias(f"k{k}"), F.col("e").alias(f"e{k}")), F.lower(F.col(f"row.`{c}`").cast("string")) == F.col(f"k{k}"), "left")
    best = F.coalesce(*(F.col(f"e{k}") for k in range(len(keys))))
    return out.select("row", best.alias("best")).select(*(F.col(f"row.`{c}`").alias(c) for c in rows.columns), *(F.col(f"best.`{c}`").alias(c) for c in keep))


def join_titles(rows: DataFrame, title: str, table: DataFrame, table_title: str, order: str, keep: list[str]) -> DataFrame:
    """``rows`` with ``keep`` of the entry of equal title, spelling and punctuation aside; the last by
    ``order`` counts."""
    last = table.select(title_key(F.col(f"`{table_title}`")).alias("k"), F.struct(F.col(f"`{order}`").alias("o"), *(F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(keep))).alias("e")).where("k <> ''").groupBy("k").agg(F.max("e").alias("e"))
    out = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")).join(last, title_key(F.col(f"row.`{title}`")) == F.col("k"), "left")
    return out.select("row.*", *(F.col(f"e.x{i}").alias(c) for i, c in enumerate(keep)))
