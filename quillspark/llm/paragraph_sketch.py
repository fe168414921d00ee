"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are hashed to 64-bit digests; a paragraph's second, third ... occurrence
has a digest of its own.  Every text is cut by one rule, whatever its length: at line ends and behind the
marks that end a sentence, within its first ``HEAD`` characters also behind those that end a clause, and what is
still longer than ``LONGEST`` characters into pieces of that length.  A sketch has cells of (count, digests xor-ed, checks
xor-ed) in three tables, and each digest is in one cell of each table.  Two sketches subtract cell
by cell, and peeling cells that hold one digest recovers the digests that differ between the texts.
Where peeling fails, both sketches are made again larger, with several cells to each digest, and with twice as
many at each further retry.  A larger sketch is kept as its filled cells only, and its tables are made one after
the other: since cells are sums, a table less the digests peeled so far is the table of those that are left.
Everything is built from SQL functions and stays in one row, so a document's sketches never leave the task that
holds its text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import parallelism

#: Cells of one table of a sketch, and its tables.
CELLS, TABLES = 8, 3
#: Cells for each digest in a table of the first larger sketch, and the number of retries.
ROOM, RETRIES = 4, 6
#: Rounds of peeling; each takes out every digest that stands alone in a cell.
ROUNDS = 8
#: Characters of a text that are cut finer, those of the longest piece, and digests that are numbered together.
HEAD, LONGEST, STRETCH = 400, 40, 512
#: Text bytes of a range of neighbouring documents, and the most ranges (two numbers of each go to the driver).
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 16
_FIRST, _TOP, _END = -(1 << 63), (1 << 63) - 1, (1 << 31) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pieces(text: Column) -> Column:
    """A text's paragraphs, cut by the one rule; blank ones are left out."""
    long = lambda p: F.length(p) > LONGEST
    cut = lambda p: F.when(long(p), F.transform(F.sequence(F.lit(1), F.length(p), F.lit(LONGEST)), lambda i: F.substring(p, i, F.lit(LONGEST)))).otherwise(F.array(p))
    parts = lambda c: F.when(F.exists(c, long), F.flatten(F.transform(c, cut))).otherwise(c)
    head = F.split(F.substring(text, 1, HEAD), r"(?<=[.!?,;:])\s+|\n")
    rest = F.when(F.length(text) > HEAD, F.split(F.substring(text, HEAD + 1, _END), r"(?<=[.!?])\s+|\n")).otherwise(F.array().cast("array<string>"))
    return F.filter(let(F.concat(head, rest), parts), lambda p: F.trim(p) != "")


def digests(text: Column) -> Column:
    """Array of the digests of a text's paragraphs; NULL counts as empty."""

    def numbered(offset: Column, part: Column) -> Column:
        """A stretch of sorted values, from ``offset`` on, each with the number of its equals before it."""

        def value(x: Column, i: Column) -> Column:
            n = F.when(x == F.get(part["x"], F.lit(0)), offset + i - part["first"]).otherwise(i - F.array_position(part["x"], x) + 1)
            return F.when(n > 0, F.xxhash64(x, n.cast("bigint"))).otherwise(x)

        return F.transform(part["x"], value)

    def number(sorted_: Column) -> Column:  # stretch by stretch, so that no place is searched for in a long array
        starts = F.when(F.size(sorted_) > 0, F.sequence(F.lit(0), F.size(sorted_) - 1, F.lit(STRETCH))).otherwise(F.array().cast("array<int>"))
        part = lambda o: F.struct(F.slice(sorted_, o + 1, F.lit(STRETCH)).alias("x"), (F.array_position(sorted_, F.get(sorted_, o)) - 1).alias("first"))
        return F.flatten(F.transform(starts, lambda o: let(part(o), lambda p: numbered(o, p))))

    numbers = lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), s).otherwise(number(s))
    return let(F.sort_array(F.transform(pieces(F.coalesce(text, F.lit(""))), lambda p: F.xxhash64(p))), numbers)


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(7))


def _entry(digest: Column, sign: Column, level: Column) -> Column:
    """A digest with its side, its check and a mask of its cells; each level uses bits of its own."""
    bits = lambda t: F.call_function("shiftrightunsigned", digest, level * 9 + 3 * t).bitwiseAND(F.lit(CELLS - 1)).cast("int")
    one = lambda t: F.call_function("shiftleft", F.lit(1 << (CELLS * t)), bits(t))
    return F.struct(digest.alias("k"), sign.alias("s"), _check(digest).alias("h"), one(0).bitwiseOR(one(1)).bitwiseOR(one(2)).alias("m"))


def _bits() -> Column:
    """The masks of the cells in order, as a constant."""
    return F.split(F.lit(",".join(str(1 << i) for i in range(TABLES * CELLS))), ",").cast("array<int>")


def cells(array: Column, level: Column) -> Column:
    """Sketch of an array of digests."""
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("h"))

    def cell(known: Column, bit: Column) -> Column:
        mine = F.filter(known, lambda x: x["m"].bitwiseAND(bit) != 0)
        return F.aggregate(mine, zero, lambda a, x: F.struct((a["c"] + x["s"]).alias("c"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["h"].bitwiseXOR(x["h"]).alias("h")))

    return let(F.transform(array, lambda d: _entry(d, F.lit(1), level)), lambda known: F.transform(_bits(), lambda bit: cell(known, bit)))


def sketched(text: Column) -> Column:
    """struct<d, c> of a text's digests and their sketch."""
    return let(digests(text), lambda d: F.struct(d.alias("d"), cells(d, F.lit(0)).alias("c")))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(difference: Column, level: Column) -> Column:
    """struct<cells, found, more> after peeling: the digests ``k`` of the first side (``s`` is 1) and of the second
    (-1), and what is left."""
    start = F.struct(difference.alias("cells"), F.array().cast("array<struct<k:bigint,s:int>>").alias("found"), F.lit(True).alias("more"))

    def alone(state: Column) -> Column:
        pure = F.filter(state["cells"], _alone)
        signed = F.array_distinct(F.transform(pure, lambda x: F.struct(x["k"].alias("k"), x["c"].alias("s"))))
        return F.transform(signed, lambda x: _entry(x["k"], x["s"], level))

    def remove(cell: Column, found: Column, bit: Column) -> Column:
        mine = F.filter(found, lambda x: x["m"].bitwiseAND(bit) != 0)
        return F.aggregate(mine, cell, lambda a, x: F.struct((a["c"] - x["s"]).alias("c"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["h"].bitwiseXOR(x["h"]).alias("h")))

    def take(state: Column, found: Column) -> Column:
        return F.when(
            F.size(found) > 0,
            F.struct(
                F.zip_with(state["cells"], _bits(), lambda cell, bit: remove(cell, found, bit)).alias("cells"),
                F.concat(state["found"], F.transform(found, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s")))).alias("found"),
                F.lit(True).alias("more"),
            ),
        ).otherwise(F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(False).alias("more")))

    def round_(state: Column, _: Column) -> Column:
        return F.when(state["more"] & failed(state), let(alone(state), lambda found: take(state, found))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)


def failed(state: Column) -> Column:
    return F.exists(state["cells"], lambda x: (x["c"] != 0) | (x["k"] != 0))


def _filled(rest: Column, size: Column, salt: Column) -> Column:
    """The filled cells of a table of ``size`` cells: their sums and the digests in them."""
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("h"))
    placed = F.sort_array(F.transform(rest, lambda x: F.struct(F.pmod(F.xxhash64(x["k"], salt), size).alias("g"), x["k"].alias("k"), x["s"].alias("s"))))
    starts = lambda o: F.filter(F.sequence(F.lit(1), F.size(o)), lambda i: (i == 1) | (F.get(o, i - 2)["g"] != F.get(o, i - 1)["g"]))
    added = lambda a, x: F.struct((a["c"] + x["s"]).alias("c"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["h"].bitwiseXOR(_check(x["k"])).alias("h"))
    cell = lambda inside: F.struct(F.aggregate(inside, zero, added).alias("sum"), inside.alias("inside"))

    def cut(o: Column, at: Column) -> Column:
        return F.transform(at, lambda i, j: let(F.slice(o, i, F.coalesce(F.get(at, j + 1), F.size(o) + 1) - i), cell))

    return let(placed, lambda o: let(starts(o), lambda at: cut(o, at)))


def _alone(cell: Column) -> Column:
    return (F.abs(cell["c"]) == 1) & (_check(cell["k"]) == cell["h"])


def differing(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """struct<n, left> of how many digests differ between two arrays, as peeled from the difference of their sketches,
    and how many no retry could peel (those are counted as differing)."""
    signed = lambda side, sign: F.transform(side, lambda d: F.struct(F.lit(0).cast("bigint").alias("g"), d.alias("k"), F.lit(sign).alias("s")))
    none = F.array().cast("array<struct<g:bigint,k:bigint,s:int>>")

    def first(peeled: Column) -> Column:
        rest = F.when(failed(peeled), F.concat(signed(a, 1), signed(b, -1))).otherwise(none)
        return F.struct(F.when(failed(peeled), 0).otherwise(F.size(peeled["found"])).alias("n"), rest.alias("rest"), F.lit(ROOM // 2).cast("bigint").alias("room"))

    def peeled(state: Column, table: Column, size: Column) -> Column:
        filled = lambda x: (x["sum"]["c"] != 0) | (x["sum"]["k"] != 0)
        mixed = F.filter(table, lambda x: filled(x) & ~_alone(x["sum"]))
        n = state["n"] + F.size(F.filter(table, lambda x: _alone(x["sum"])))
        return F.struct(n.alias("n"), F.flatten(F.transform(mixed, lambda x: x["inside"])).alias("rest"), size.alias("room"))

    def retry(state: Column, step: Column) -> Column:  # ``room`` is the number of cells of a table, but before the first one those for each digest
        size = F.when(step == 0, 2 * state["room"] * F.size(state["rest"])).when(step % TABLES == 0, 2 * state["room"]).otherwise(state["room"])
        again = let(size, lambda cells_: let(_filled(state["rest"], cells_, step), lambda table: peeled(state, table, cells_)))
        return F.when(F.size(state["rest"]) > 0, again).otherwise(state)

    start = let(peel(subtract(cells_a, cells_b), F.lit(0)), first)
    state = F.aggregate(F.sequence(F.lit(0), F.lit(RETRIES * TABLES - 1)), start, retry)
    return let(state, lambda s: F.struct((s["n"] + F.size(s["rest"])).alias("n"), F.size(s["rest"]).alias("left")))


def likeness(a: Column, b: Column, different: Column) -> Column:
    """Share of common digests among all of both texts; 1 where neither has any."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - different) / (both + different))


def as_text(digests_: Column, sketch: Column) -> Column:
    """A fingerprint as text: the number of digests, and the sketch's counts, digests and checks, packed in base 64."""
    cell = lambda x: F.concat(F.lpad(F.hex(x["c"].bitwiseAND(F.lit(0xFFFF))), 4, "0"), F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["h"].bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.base64(F.unhex(F.concat(F.lpad(F.hex(F.size(digests_)), 8, "0"), F.array_join(F.transform(sketch, cell), ""))))


def _begin(text: Column) -> Column:
    """The first seven bytes of a text as a number, which orders texts as their bytes do."""
    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")


def _bounds(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Ends of about ``parts`` ranges of (ord, begin) of about equal size; an ord with many rows is split by ``begin``."""
    fractions = lambda n: [i / n for i in range(1, n)]
    cuts = rows.agg(F.percentile_approx("ord", fractions(parts), 100 * parts)).first()[0] or [] if parts > 1 else []
    times = Counter(cuts)
    bounds = {(o, _TOP) for o in cuts}
    if heavy := [o for o, n in times.items() if n > 1]:
        n = 1 + max(times.values())
        inner = rows.where(F.col("ord").isin(heavy)).groupBy("ord").agg(F.percentile_approx("begin", fractions(n), 100 * n).alias("cuts"))
        bounds |= {(r["ord"], k) for r in inner.collect() for k in r["cuts"]}
    return sorted(bounds)


def _range(bounds: list[tuple[int, int]]) -> Column:
    """Number of the bounds that lie below (ord, begin), by bisection over constant arrays."""
    if not bounds:
        return F.lit(0)
    ords, begins = (F.split(F.lit(",".join(str(b[i]) for b in bounds)), ",").cast("array<bigint>") for i in (0, 1))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))

    def further(at: Column, step: Column) -> Column:
        o, k = F.get(ords, at + step - 1), F.get(begins, at + step - 1)
        return F.when((o < F.col("ord")) | ((o == F.col("ord")) & (k < F.col("begin"))), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, own, next_text, next_own``: each row with the text of the row after it in descending
    doc_id order and both texts' digests and sketches, each made once; the first row follows the last.

    Rows are dealt into ranges of about ``RANGE_BYTES`` (more where there are over ``MOST_RANGES`` of them); the head
    of each range is also sent to the range before it.  Only the ranges' ends go to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_FIRST)).alias("ord"))
    rows = rows.withColumn("begin", _begin(F.col("text")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = _bounds(rows, min(MOST_RANGES, max(2 * parallelism(spark), size // RANGE_BYTES)))
    rows = rows.withColumn("b", _range(bounds))
    tops = {r["b"]: r["top"] for r in rows.groupBy("b").agg(F.max(F.struct("ord", "begin")).alias("top")).collect()}
    filled = sorted(tops)
    before = [(tops[x]["ord"], tops[x]["begin"], y) for x, y in zip(filled, [*filled[1:], *filled[:1]])]  # the range that ends with this one's head
    heads = F.broadcast(spark.createDataFrame(before, "ord bigint, begin bigint, to int"))  # MOST_RANGES rows at most
    own = F.struct(F.col("b"), F.lit(0).alias("ghost"))
    copies = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("b"), F.lit(1).alias("ghost"))))
    dealt = rows.join(heads, ["ord", "begin"], "left").select("doc_id", "text", "ord", F.explode(copies).alias("at")).select("doc_id", "text", "ord", "at.b", "at.ghost")
    dealt = dealt.repartition(max(len(bounds) + 1, parallelism(spark)), "b")
    order = Window.partitionBy("b").orderBy("ghost", F.col("ord").desc(), F.col("text").desc())
    dealt = dealt.withColumn("own", sketched(F.col("text")))
    following = dealt.withColumn("next", F.lead(F.struct("text", "own")).over(order)).where("ghost = 0")
    return following.select("doc_id", "text", "own", F.col("next.text").alias("next_text"), F.col("next.own").alias("next_own"))


def compare(versions: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, unpeeled`` of rows ``doc_id, text, own, next_text, next_own``.

    The edited text has its last third of code points replaced by the next text's first ones.  A fingerprint
    is the sketch of ``3 * CELLS`` cells and the number of digests: its size doesn't grow with the text, and it
    answers differences of up to some 18 digests alone.  For larger ones the sketches are made again
    larger, from the same digests, so that both likenesses are exact.
    ``unpeeled`` counts digests that no retry could peel (0 but for chance).
    """
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = versions.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "next_own", sketched(F.col("edited")).alias("edited_own"))
    differ = lambda other: differing(F.col("own.d"), F.col(f"{other}.d"), F.col("own.c"), F.col(f"{other}.c"))
    rows = rows.withColumns({"by_edit": differ("edited_own"), "by_next": differ("next_own")})
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own.d"), F.col("own.c")).alias("fingerprint"),
        as_text(F.col("edited_own.d"), F.col("edited_own.c")).alias("edited_fingerprint"),
        likeness(F.col("own.d"), F.col("edited_own.d"), F.col("by_edit.n")).alias("near_edited"),
        likeness(F.col("own.d"), F.col("next_own.d"), F.col("by_next.n")).alias("near_next"),
        (F.col("by_edit.left") + F.col("by_next.left")).alias("unpeeled"),
    )


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likenesses (see ``compare``).

    NULL texts count as empty and NULL ids as the lowest; rows of equal id follow each
    other in descending order of text, and repeated rows each give a row.  A lone row is
    followed by itself; an empty table gives an empty table.  Other columns are ignored.  Texts of any length
    are worked whole: the work grows with the number of pieces, times its logarithm for the retries.
    """
    return compare(with_next(docs))
