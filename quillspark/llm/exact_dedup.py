"""Exact duplicates with the heavy hitters split off.

Texts are equal where they are identical after lower-casing A-Z, told by SHA-256.  One row
for each document (id, digest) is written to the shared folder, and everything after works
on those short rows:

1. A Misra-Gries summary of the digests is made where rows are read (``approx_top_k``'s
   sketch is that summary, purged at the median of its counters); summaries of groups of
   tasks are merged first, those of the groups after.
2. The candidates that it names are counted exactly, by full digest.  Winners have at least
   one ``SHARE``-th of all rows; their number is bounded by ``CANDIDATES``.
3. The winners, with the row that stays and the size, are broadcast: rows of heavy digests
   get their answer where they are read and never meet in one task.
4. The other digests are shuffled as usual.  None of their groups has more than a
   ``SHARE``-th of the rows, which is what an ordinary partition holds.

Nothing depends on the summary but the way a row takes: a heavy digest that it missed would
be answered by the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, materialize

#: Counters of a summary.
TRACKED = 1 << 15
#: Digests that are counted exactly; 2 * SHARE, since an estimate is at most twice its lower bound.
CANDIDATES = 1 << 13
#: A digest with this part of all rows or more is heavy; the summary's error is below it.
SHARE = 1 << 12
#: Groups of tasks whose summaries are merged apart.
MERGES = 64


def normal(text: Column) -> Column:
    """A-Z lower-cased; NULL is empty.  ``lower`` does the same where all is ASCII, and faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, row`` of every row; ``row`` tells rows of one id apart."""
    digest = F.unhex(F.sha2(normal(F.col("text")).cast("binary"), 256))
    return docs.select("doc_id", digest.alias("digest")).withColumn("row", F.monotonically_increasing_id())


def candidates(rows: DataFrame) -> DataFrame:
    """``h``: hashes of the digests that a Misra-Gries summary finds frequent; at most ``CANDIDATES``."""
    hashed = rows.select(F.xxhash64("digest").alias("h"), (F.spark_partition_id() % MERGES).alias("merge"))
    parts = hashed.groupBy("merge").agg(F.expr(f"approx_top_k_accumulate(h, {TRACKED})").alias("summary"))
    whole = parts.groupBy((F.col("merge") - F.col("merge")).alias("all")).agg(F.expr(f"approx_top_k_combine(summary, {TRACKED})").alias("summary"))
    return whole.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {CANDIDATES})")).alias("found")).select("found.item").toDF("h")


def winner() -> Column:
    """The row that stays: the largest doc_id, NULL below every other, then the last row."""
    return F.max(F.struct("doc_id", "row"))


def heavy_digests(rows: DataFrame, n_rows: int) -> DataFrame:
    """``digest, last, group_size`` of the digests with at least a ``SHARE``-th of all rows, and two."""
    likely = rows.join(F.broadcast(candidates(rows)), F.xxhash64("digest") == F.col("h"), "left_semi")
    counted = likely.groupBy("digest").agg(winner().alias("last"), F.count("*").alias("group_size"))
    return counted.where(F.col("group_size") >= max(2, n_rows // SHARE))


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` of every row, dropped ones too.

    ``keep_id`` is the largest doc_id of the rows whose text equals this row's, and
    ``kept`` is true for exactly one row of each group: the one of largest doc_id, and of
    rows that repeat that id the one read last.  NULL texts count as empty.  NULL ids are
    below every other; a group of NULL ids alone has a NULL ``keep_id`` and keeps one row.
    Texts of any length are read whole.  An empty table gives an empty table; other columns
    are ignored, whatever their names.
    """
    rows = materialize(digests(docs), "op12-digests")
    heavy = materialize(heavy_digests(rows, rows.count()), "op12-heavy")
    known = rows.join(F.broadcast(heavy), "digest", "left")
    light = known.where(F.col("group_size").isNull()).select("doc_id", "digest", "row")
    group = Window.partitionBy("digest")
    ordinary = light.select("doc_id", "digest", "row", winner().over(group).alias("last"), F.count("*").over(group).alias("group_size"))
    split = known.where(F.col("group_size").isNotNull()).select("doc_id", "digest", "row", "last", "group_size")
    return split.unionByName(ordinary).select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "digest")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text no row that stays before them has:
    one row of each group of equal texts, that of the largest doc_id.

    A row is told by its id and digest, so rows that repeat both an id and a text are one;
    the columns of any of them may stay.  NULL ids count as one id.
    """
    kept = mark_duplicates(docs).where("kept").select(F.struct("doc_id", "digest").alias("k"))
    mine = F.struct(docs["doc_id"].alias("doc_id"), F.unhex(F.sha2(normal(docs["text"]).cast("binary"), 256)).alias("digest"))
    wrapped = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("whole"), mine.alias("m"))
    joined = wrapped.join(kept, F.col("m").eqNullSafe(F.col("k")), "left_semi")
    return joined.dropDuplicates(["m"]).select("whole.*")
