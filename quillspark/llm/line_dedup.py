"""Line dedup by pairwise alignment.

Anchors are hashes of the shortest runs of consecutive lines that hold ``min_words`` words:
rare by their length, and at least one starts every common block that is worth deleting.
Each anchor that several documents share links every later holder to the earliest one,
so the pairs grow with the text and never with the square of a group, and no anchor is too
frequent to be used.  Each pair of overlapping documents is aligned with patience diff on line hashes.
Blocks of consecutive aligned lines with ``min_words`` words or more are deleted from the
later document, and so are blocks that cross the alignment.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded, limit_batches, materialize

#: Words of the shortest block that is deleted.
MIN_WORDS = 20
_LAST = (1 << 63) - 1
_PRIME, _BASE = (1 << 89) - 1, 0x9E3779B97F4A7C15F39CC0


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], increasing in both.

    Common ends are aligned first; then the longest increasing chain of lines that occur
    once on each side splits the rest.  A stretch without such lines is split at the
    common line of fewest occurrences.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        ca, cb = Counter(a[i:m]), Counter(b[j:n])
        common = ca.keys() & cb.keys()
        if not common:
            continue
        once = {x for x in common if ca[x] == cb[x] == 1}
        if once:
            at = {b[k]: k for k in range(j, n) if b[k] in once}
            chain = _longest_chain([(k, at[a[k]]) for k in range(i, m) if a[k] in once])
        else:
            line = min(common, key=lambda x: (ca[x] * cb[x], b.index(x, j, n)))
            chain = [(a.index(line, i, m), b.index(line, j, n))]
        for x, y in chain:
            todo.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        todo.append((i, m, j, n))
    return sorted(out)


def _longest_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    tails, last, before = [], [], {}
    for p in pairs:
        at = bisect_left(tails, p[1])
        before[p] = last[at - 1] if at else None
        tails[at : at + 1], last[at : at + 1] = [p[1]], [p]
    out, p = [], last[-1]
    while p:
        out.append(p)
        p = before[p]
    return out[::-1]


def common_blocks(a: list, b: list, words: list[int], min_words: int) -> list[int]:
    """Positions in ``b`` of all runs of lines that stand in ``a`` as well and hold at least ``min_words`` of b's ``words``.

    Runs that cross the alignment are found by their shortest parts of ``min_words`` words.
    """
    out, block, size, last = set(), [], 0, None
    for i, j in [*patience(a, b), (-9, -9)]:
        if last and (i, j) == (last[0] + 1, last[1] + 1):
            block.append(j)
            size += words[j]
        else:
            if size >= min_words:
                out.update(block)
            block, size = [j], words[j] if j >= 0 else 0
        last = (i, j)
    return sorted(out | crossing_runs(a, b, words, min_words))


def crossing_runs(a: list, b: list, words: list[int], min_words: int) -> set[int]:
    """Positions in ``b`` of all common runs of at least ``min_words`` words, wherever they stand in ``a``.

    Such a run is covered by the shortest parts of ``min_words`` words that begin, and those
    that end, at its lines; equal lines hold equally many words, so both sides are cut alike.
    """
    weight = dict(zip(b, words))
    number = {x: k for k, x in enumerate(weight, 1)}
    marks = [0] * (len(b) + 1)
    for way in (1, -1):
        runs = _shortest([weight.get(x) for x in a[::way]], min_words)
        known = set(_run_hashes([number.get(x, 0) for x in a[::way]], runs))
        runs = list(_shortest(words[::way], min_words))
        for (j, n), h in zip(runs, _run_hashes([number[x] for x in b[::way]], runs)):
            if h in known:
                j, n = (j, n) if way == 1 else (len(b) - n, len(b) - j)
                marks[j] += 1
                marks[n] -= 1
    return {j for j, depth in enumerate(accumulate(marks)) if depth}


def _run_hashes(numbers: list[int], runs: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Length and hash of each run (start, end), from the hashes of all beginnings."""
    begun, power = [0], [1]
    for x in numbers:
        begun.append((begun[-1] * _BASE + x) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    for i, m in runs:
        yield m - i, (begun[m] - begun[i] * power[m - i]) % _PRIME


def _shortest(words: list[int | None], min_words: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the shortest run of ``min_words`` words from each position; none crosses a None."""
    end, total = 0, 0
    for start in range(len(words)):
        if end < start:
            end, total = start, 0
        while total < min_words and end < len(words) and words[end] is not None:
            total += words[end]
            end += 1
        if total >= min_words:
            yield start, end
        if end > start:
            total -= words[start]


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """``ord, h, lines, words, anchors`` of each row: line hashes, their word counts and the anchors."""
    from xxhash import xxh64_intdigest as xxh64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            lines, words, anchors = [], [], []
            for text in batch.column(2).to_pylist():
                parts = [p.strip() for p in (text or "").encode().split(b"\n")]
                hashes = np.array([xxh64(p) for p in parts], np.uint64)
                counts = np.array([len(p.split()) for p in parts], np.int32)
                lines.append(hashes.tobytes())
                words.append(counts.tobytes())
                ends = np.cumsum(counts)
                stop = np.searchsorted(ends, ends - counts + min_words)  # last line of the run from each line
                found = set()
                for k in np.flatnonzero((stop < len(parts)) & (counts > 0)).tolist():
                    run_hashes = hashes[k : stop[k] + 1]
                    run_hashes = run_hashes[counts[k : stop[k] + 1] > 0]
                    found.add(xxh64(run_hashes.tobytes()))
                anchors.append(np.array(sorted(found), np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.binary()), pa.array(words, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))], ["ord", "h", "lines", "words", "anchors"])

    return docs.select("ord", "h", "text").mapInArrow(run, "ord bigint, h bigint, lines binary, words binary, anchors array<bigint>")


def overlapping_pairs(table: DataFrame) -> DataFrame:
    """``ord, h, owner``: each later document with the earliest document of each of its shared anchors."""
    anchors = table.select("ord", "h", F.explode("anchors").alias("anchor"))
    owners = anchors.groupBy("anchor").agg(F.min("ord").alias("owner"), F.max("ord").alias("last")).where("last > owner").select("anchor", "owner")
    return anchors.join(owners, "anchor").where("ord > owner").select("ord", "h", "owner").distinct()


def deletions(table: DataFrame, pairs: DataFrame, min_words: int) -> DataFrame:
    """``ord, h, gone, earlier``: deleted line numbers of later documents and the documents they align with."""
    left = table.select(F.col("ord").alias("owner"), F.col("lines").alias("a"))
    right = table.select("ord", "h", F.col("lines").alias("b"), "words")
    both = pairs.join(right, ["ord", "h"]).join(left, "owner").select("ord", "h", "owner", "a", "b", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ord_, h, owner, a, b, words in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.frombuffer(words, np.int32).tolist()
                if a == b:
                    gone = list(range(len(counts))) if sum(counts) >= min_words else []
                else:
                    gone = common_blocks(np.frombuffer(a, np.uint64).tolist(), np.frombuffer(b, np.uint64).tolist(), counts, min_words)
                if gone:
                    rows.append((ord_, h, owner, gone))
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["ord", "h", "owner", "gone"])

    found = both.mapInArrow(run, "ord bigint, h bigint, owner bigint, gone array<int>")
    return found.groupBy("ord", "h").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"), F.sort_array(F.collect_set("owner")).alias("earlier"))


def dedupe_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns, with common blocks deleted from ``text`` of later documents, and
    ``removed_lines`` (their number) and ``earlier`` (ids of the aligned earlier documents) beside them.

    Documents are ordered by doc_id, NULL ids last; rows of equal id are not compared with
    each other.  NULL texts stay NULL and empty ones empty.  Lines are compared without
    white space at their ends; blank lines belong to blocks but weigh nothing.  A column that is named
    like one of the two new ones is replaced.  An empty table gives an empty table.
    """
    limit_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("removed_lines", "earlier")]
    keyed = docs.select(*names, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("__ord"), F.xxhash64("text").alias("__h"))
    table = materialize(line_table(keyed.select(F.col("__ord").alias("ord"), F.col("__h").alias("h"), "text"), min_words), "op10-lines")
    distinct = table.select("ord", "h", "lines", "words", "anchors").dropDuplicates(["ord", "h"])
    pairs = overlapping_pairs(table)
    gone = materialize(deletions(distinct, pairs, min_words), "op10-gone")
    joined = keyed.hint("merge").join(gone.select(F.col("ord").alias("__ord"), F.col("h").alias("__h"), F.col("gone").alias("__gone"), F.col("earlier").alias("__earlier")), ["__ord", "__h"], "left")
    split = F.array(F.split("text", "\n"))
    kept = F.element_at(F.transform(split, lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")), lambda i: F.get(lines, i)), "\n")), 1)
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    out = [text.alias("text") if c == "text" else F.col(c) for c in names]
    return joined.select(*out, F.coalesce(F.size("__gone"), F.lit(0)).alias("removed_lines"), F.coalesce("__earlier", F.array().cast("array<bigint>")).alias("earlier"))
