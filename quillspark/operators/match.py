"""Matching texts, names and titles; an ambiguous match is refused, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.mentions import find_mentions


def shared_shingles(left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int) -> DataFrame:
    """``left_id, right_id, shared``: how many distinct ``k``-word shingles the texts share.

    The join is on 64-bit hashes, and the shingles themselves are compared.
    """

    def exploded(df: DataFrame, key: str, hash_: str, shingle: str) -> DataFrame:
        rows = df.select(key, F.explode(F.array_distinct(T.shingles(T.words(F.col("text")), k))).alias(shingle))
        return rows.withColumn(hash_, F.xxhash64(shingle))

    a, b = exploded(left, left_id, "__ha", "__a"), exploded(right, right_id, "__hb", "__b")
    return a.join(b, (F.col("__ha") == F.col("__hb")) & (F.col("__a") == F.col("__b"))).groupBy(left_id, right_id).agg(F.count("*").alias("shared"))


def containing(texts: DataFrame, quotes: DataFrame, text_id: str, quote_id: str) -> DataFrame:
    """``quote_id, text_id``: the texts that contain each quote, both as ``T.quote_key``.

    One pass over the texts with an automaton of all quotes; NULL and empty quotes are in none.
    """
    q = quotes.select(F.col(quote_id).alias("quote"), T.quote_key(F.col("text")).alias("key"))
    t = texts.select(F.col(text_id).alias("id"), T.quote_key(F.col("text")).alias("t"))
    return find_mentions(t, "id", ["t"], q, "quote", "key", folded=False).select(F.col("quote").alias(quote_id), F.col("id").alias(text_id)).distinct()


def unique_index(names: DataFrame, id_: str, key: Column) -> DataFrame:
    """``key, id`` of the keys that lead to one id only."""
    return names.select(key.alias("key"), F.col(id_).alias("id")).where("key <> ''").groupBy("key").agg(F.min("id").alias("id"), F.count_distinct("id").alias("__n")).where("__n = 1").drop("__n")


def resolve_names(mentions: DataFrame, mention: str, roster: DataFrame, id_: str, name: str) -> DataFrame:
    """``mention, id, via``: by full name, else by a surname that one entity has."""
    full = unique_index(roster, id_, T.fold_name(T.clean_name(F.col(name)))).withColumnsRenamed({"key": "__f", "id": "__fid"})
    last = unique_index(roster, id_, F.element_at(F.split(T.fold_name(T.clean_name(F.col(name))), " "), -1)).withColumnsRenamed({"key": "__l", "id": "__lid"})
    key = T.fold_name(T.clean_name(F.col(mention)))
    m = mentions.select(mention).distinct().withColumns({"__f": key, "__l": F.element_at(F.split(key, " "), -1)})
    j = m.join(full, "__f", "left").join(last, "__l", "left")
    return j.select(mention, F.coalesce("__fid", "__lid").alias("id"), F.when(F.col("__fid").isNotNull(), "name").when(F.col("__lid").isNotNull(), "surname").alias("via"))


def resolve_titles(queries: DataFrame, query: str, titles: DataFrame, title: str, least: float = 0.6) -> DataFrame:
    """``query, title, via``: the title of equal word set, else of a containing one, else of
    Jaccard similarity of ``least`` or more; of several equally good ones none.

    Candidates share at least one word, so the join is on words.
    """
    stop = F.array(*(F.lit(w) for w in ("the", "a", "an", "of", "and", "bill")))
    token_set = lambda c: F.array_sort(F.array_distinct(F.array_except(T.words(F.regexp_replace(c, "[^A-Za-z0-9 ]", " ")), stop)))
    q = queries.select(query).distinct().withColumn("__q", token_set(F.col(query)))
    t = titles.select(F.col(title).alias("__title")).distinct().withColumn("__t", token_set(F.col("__title")))
    pairs = q.select(query, "__q", F.explode("__q").alias("__w")).join(t.select("__title", "__t", F.explode("__t").alias("__w")), "__w").select(query, "__q", "__title", "__t").distinct()
    both = F.size(F.array_intersect("__q", "__t"))
    jaccard = both / F.size(F.array_union("__q", "__t"))
    tier = F.when(F.col("__q") == F.col("__t"), 1).when((both == F.size("__q")) | (both == F.size("__t")), 2).when(jaccard >= least, 3)
    ranked = pairs.withColumns({"__tier": tier, "__score": F.when(tier == 3, jaccard).otherwise(1.0)}).where("__tier is not null")
    best = ranked.groupBy(query).agg(F.min(F.struct("__tier", (-F.col("__score")).alias("__score"))).alias("__best"))
    top = ranked.join(best, query).where((F.col("__tier") == F.col("__best.__tier")) & (-F.col("__score") == F.col("__best.__score")))
    one = top.groupBy(query, "__tier").agg(F.min("__title").alias("title"), F.count("*").alias("__n")).where("__n = 1")
    via = F.element_at(F.array(F.lit("equal"), F.lit("contained"), F.lit("similar")), F.col("__tier"))
    return q.select(query).join(one.select(query, "title", via.alias("via")), query, "left")


def resolve_fuzzy(mentions: DataFrame, mention: str, roster: DataFrame, id_: str, name: str, least: float = 0.85) -> DataFrame:
    """``mention, id``: the one entity whose folded name is alike to ``least`` (sequence matching).

    Meant for the few distinct names that no exact tier resolved.  Candidates share the first
    letter of some word, so names are joined on those; two entities that qualify refuse the match.
    """
    import difflib
    from collections.abc import Iterator

    import pyarrow as pa

    key = lambda c: T.fold_name(T.clean_name(F.col(c)))
    initials = lambda c: F.array_distinct(F.transform(F.split(c, " "), lambda w: F.substring(w, 1, 1)))
    m = mentions.select(mention).distinct().withColumn("__m", key(mention))
    r = roster.select(F.col(id_).alias("id"), key(name).alias("__r")).distinct()
    pairs = m.select(mention, "__m", F.explode(initials(F.col("__m"))).alias("__i")).join(r.select("id", "__r", F.explode(initials(F.col("__r"))).alias("__i")), "__i").select(mention, "__m", "id", "__r").distinct()

    def close(arrays: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in arrays:
            yield pa.array([difflib.SequenceMatcher(None, x, y).ratio() >= least for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())

    close.__annotations__ = {"arrays": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    found = pairs.where(F.arrow_udf(close, "boolean")("__m", "__r")).groupBy(mention).agg(F.min("id").alias("id"), F.count_distinct("id").alias("__n")).where("__n = 1").drop("__n")
    return m.select(mention).join(found, mention, "left")
