"""Benchmark decontamination by template windows.

Texts are canonicalised to templates: numbers, names (capitalised words inside a sentence)
and units after numbers become typed placeholders, all else is lower-cased words.  Windows of
``WINDOW`` template tokens of a benchmark item, at every token, are hash-joined with those of the documents;
windows poor in literal words are joined by their values.  Every hit gives an alignment (document,
item, offset).  Along it the templates are compared token by token, and the slots must be consistent: one
value of the item stands for one value in the document, and different ones for different
ones.  So an item that is copied with other numbers or names is found, while mere likeness of
form is not.  Where slots contradict each other, each run of matched tokens is judged by itself.
Everything is built from SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize

#: Template tokens of a window; literal words below which a window is matched by the values of its slots.
WINDOW, LITERALS = 8, 5
#: Items are matched whole down to this many tokens.
SHORTEST = 5
#: Share of an item's tokens, or number of them, that makes a leak.
COVERAGE, TOKENS = 0.5, 25
#: Rows up to which a side is broadcast (a few tens of MB at most); beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Units of measurement and currency words.
UNITS = [
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "lbs", "oz", "ml", "cl", "l", "ms", "s", "min", "h", "hz", "khz", "mhz", "ghz", "w", "kw", "kwh", "v", "a", "j", "kj", "cal", "kcal", "pa", "kpa", "mph", "kmh", "kb", "mb", "gb", "tb",
    "percent", "degrees", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces",
    "liter", "liters", "litre", "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "eur", "usd", "gbp",
]
_NAME, _NUMBER, _UNIT = "\u0001", "\u0002", "\u0003"
_GAP = "[^\\p{L}\\p{M}\\p{N}\u0001\u0002\u0003]+"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _marked(text: Column) -> Column:
    """The text with its slots marked: each keeps its value behind the mark of its type."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), "[\u0001-\u0003]", " ")
    joined = F.regexp_replace(joined, "(?<=\\d)[.,](?=\\d)", "")
    named = F.regexp_replace(joined, "(?<=[\\p{L}\\p{N},;:)] )(?=\\p{Lu}\\p{Ll})", _NAME)
    numbered = F.regexp_replace(named, "(?<![\\p{L}\\p{M}\\p{N}])(?=\\p{N})", _NUMBER)
    return F.regexp_replace(numbered, f"({_NUMBER}\\p{{N}}+ ?)(?=(?i:{'|'.join(UNITS)})(?![\\p{{L}}\\p{{N}}]))", f"$1 {_UNIT}")


def values(text: Column) -> Column:
    """Tokens of a text, in lower case; those of slots begin with the mark of their type."""
    return F.filter(F.split(F.lower(_marked(text)), _GAP), lambda t: t != "")


def template(text: Column) -> Column:
    """Template tokens: as ``values``, with nothing behind a slot's mark."""
    bare = F.regexp_replace(_marked(text), f"([{_NAME}{_NUMBER}{_UNIT}])[\\p{{L}}\\p{{M}}\\p{{N}}]+", "$1")
    return F.filter(F.split(F.lower(bare), _GAP), lambda t: t != "")


def _windows(tokens: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` of the ``values`` of a text, in order: of their template, or of
    the values themselves where fewer than ``LITERALS`` are literal."""
    least = min(LITERALS, size)
    slot = lambda t: t < F.lit("\u0004")  # noqa: E731  the marks are below every other token
    bare = F.array(F.transform(tokens, lambda t: F.xxhash64(F.when(slot(t), F.substring(t, 1, 1)).otherwise(t))))
    places = F.filter(F.transform(tokens, lambda t, i: F.when(slot(t), i)), lambda i: i.isNotNull())
    starts = F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.size(tokens) - (size - 1))).otherwise(F.array().cast("array<int>"))
    # a window is poor in literals where so many slots stand close together; most texts have none
    crowded = lambda s: F.exists(F.transform(s, lambda p, j: F.coalesce(F.get(s, j + (size - least)) - p < size, F.lit(False))), lambda x: x)

    def tested(b: Column) -> Column:
        kinds, full = F.transform(tokens, lambda t: F.when(slot(t), 0).otherwise(1)), F.transform(tokens, lambda t: F.xxhash64(t))
        window = lambda k, f, i: F.when(F.size(F.array_remove(F.slice(k, i, size), 0)) >= least, F.xxhash64(F.slice(b, i, size))).otherwise(F.xxhash64(F.slice(f, i, size), F.lit(1)))
        return _let(kinds, lambda k: _let(full, lambda f: F.transform(starts, lambda i: window(k, f, i))))

    plain = lambda b: F.transform(starts, lambda i: F.xxhash64(F.slice(b, i, size)))
    return _let(bare[0], lambda b: _let(places, lambda s: F.when(crowded(s), tested(b)).otherwise(plain(b))))


def _key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"])


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast a written table only where its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def alignments(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``key, item_id, offset``: where a window of an item stands in a document, as the
    difference of the two positions.  ``items`` holds item_id and its ``values``."""
    n = F.size("values")
    sized = items.where(n >= SHORTEST).select("item_id", "values", F.least(F.lit(WINDOW), n).alias("size"))
    by_length = F.coalesce(*(F.when(F.col("size") == s, _windows(F.col("values"), s)) for s in range(SHORTEST, WINDOW + 1)))
    wanted = materialize(sized.select("item_id", "size", F.posexplode(by_length).alias("start", "window")), "op2-windows")
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect()) or [WINDOW]  # SHORTEST to WINDOW
    found = _let(values(F.col("text")), lambda v: F.array(*(F.struct(F.lit(s).alias("size"), _windows(v, s).alias("windows")) for s in sizes)))
    by_size = docs.select(_key(docs).alias("key"), F.explode(found).alias("f")).select("key", "f.size", F.posexplode("f.windows").alias("pos", "window"))
    hits = by_size.join(_sized(wanted), ["size", "window"])
    return hits.select("key", "item_id", (F.col("pos") - F.col("start")).alias("offset")).distinct()


def _each_run(rows: DataFrame) -> DataFrame:
    """``rows`` whose slots contradict each other, with ``equal`` cut to what can be trusted.

    A run of at least a window's length is trusted whole where its values are the item's, or where no value of
    the item stands for two; in the latter, slots of different values that became one don't match.
    Besides trusted runs, only tokens of equal value match.  Rows without a trusted run go.
    """
    size = F.least(F.lit(WINDOW), F.size("tokens"))
    where = "key", "item_id", "offset"
    runs = lambda places: F.transform(places, lambda x, k: F.struct((x - k).alias("run"), x.alias("i")))
    slot = lambda i: F.get("tokens", i).isin(_NAME, _NUMBER, _UNIT)
    ours, theirs = lambda i: F.get("values", i), lambda i: F.get("d_values", i + F.col("offset"))
    same = F.filter("equal", lambda i: ours(i) == theirs(i))
    rows = rows.withColumn("same", same).withColumn("kind", F.explode(F.array(F.lit(True), F.lit(False))))
    rows = rows.withColumn("runs", runs(F.when(F.col("kind"), F.col("same")).otherwise(F.col("equal"))))
    rows = rows.withColumn("run", F.explode(F.array_distinct(F.transform("runs", lambda r: r["run"]))))
    rows = rows.withColumn("places", F.transform(F.filter("runs", lambda r: r["run"] == F.col("run")), lambda r: r["i"])).where(F.size("places") >= size)
    rows = rows.withColumn("slots", F.array_distinct(F.transform(F.filter("places", slot), lambda i: F.struct(ours(i).alias("b"), theirs(i).alias("d")))))
    one = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["b"])))
    rows = rows.where(F.col("kind") | one)
    clear = lambda i: ~slot(i) | (F.size(F.filter("slots", lambda s: s["d"] == theirs(i))) == 1)
    rows = rows.withColumn("trusted", F.filter("places", clear))
    merged = rows.groupBy(*where).agg(*(F.first(c).alias(c) for c in ("doc_id", "tokens", "values", "d_values", "same")), F.array_distinct(F.flatten(F.collect_list("trusted"))).alias("trusted"))
    return merged.withColumn("equal", F.array_union("same", "trusted"))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_tokens, n_matched, coverage, n_slots, n_changed, key``: leaked items, a row for
    each distinct document and item.

    ``n_matched`` of the item's ``n_tokens`` template tokens are covered by alignments, without
    contradicting slots; at least ``COVERAGE`` of all or ``TOKENS`` of them make a leak.
    ``n_changed`` of ``n_slots`` slots have another value in the document: 0 is a plain copy.

    NULL texts, and items of fewer than ``SHORTEST`` tokens, match nothing.  NULL ids stay.  Repeated rows give
    one row; an empty table on either side gives an empty table.  Other columns are ignored.
    """
    items = materialize(benchmark.select("item_id", template(F.col("text")).alias("tokens"), values(F.col("text")).alias("values")), "op2-items")
    hits = materialize(alignments(docs, items.select("item_id", "values")), "op2-hits")
    keys = materialize(hits.select("key").distinct(), "op2-keys")
    keyed = docs.select("doc_id", "text", _key(docs).alias("key"))
    texts = keyed.join(_sized(keys), "key").dropDuplicates(["key"]).select("key", "doc_id", template(F.col("text")).alias("d_tokens"), values(F.col("text")).alias("d_values"))
    rows = hits.join(texts, "key").join(items, "item_id")

    at = lambda array, i: F.get(array, i + F.col("offset"))
    places = F.sequence(F.lit(0), F.size("tokens") - 1)
    equal = F.filter(places, lambda i: F.get(F.col("tokens"), i) == at(F.col("d_tokens"), i))
    rows = rows.withColumn("equal", equal)
    slots = F.transform(F.filter("equal", lambda i: F.get(F.col("tokens"), i).isin(_NAME, _NUMBER, _UNIT)), lambda i: F.struct(F.get(F.col("values"), i).alias("b"), at(F.col("d_values"), i).alias("d")))
    rows = rows.withColumn("slots", slots)
    pairs, ours, theirs = F.array_distinct("slots"), F.array_distinct(F.transform("slots", lambda s: s["b"])), F.array_distinct(F.transform("slots", lambda s: s["d"]))
    rows = materialize(rows.withColumn("whole", (F.size(pairs) == F.size(ours)) & (F.size(pairs) == F.size(theirs))), "op2-aligned")
    names = "key", "item_id", "doc_id", "tokens", "equal", "slots"
    rows = rows.where("whole").select(*names).unionByName(_each_run(rows.where("not whole")).withColumn("slots", slots).select(*names))
    changed = F.size(F.filter("slots", lambda s: s["b"] != s["d"]))
    each = rows.select("key", "item_id", "doc_id", F.size("tokens").alias("n_tokens"), "equal", F.size("slots").alias("n_slots"), changed.alias("n_changed"))
    found = each.groupBy("key", "item_id").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_tokens").alias("n_tokens"),
        F.size(F.array_distinct(F.flatten(F.collect_set("equal")))).alias("n_matched"),
        F.max("n_slots").alias("n_slots"),
        F.max("n_changed").alias("n_changed"),
    )
    found = found.withColumn("coverage", F.col("n_matched") / F.col("n_tokens")).where((F.col("coverage") >= COVERAGE) | (F.col("n_matched") >= TOKENS))
    return found.select("doc_id", "item_id", "n_tokens", "n_matched", "coverage", "n_slots", "n_changed", "key")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no leaked item, with all columns."""
    leaked = materialize(find_leaks(docs, benchmark).select("key").distinct(), "op2-leaks")
    return docs.join(_sized(leaked), _key(docs) == leaked["key"], "left_anti")
