"""Near-duplicates by similarity of word shingles, on wide SimHash fingerprints.

Texts whose shingle sets are 0.8 similar (Jaccard) differ in about 15 % of SimHash bits, some ten of
64, which no grid of 64-bit fingerprints can search with a useful bound.  This variant
therefore widens the fingerprint to 256 bits and uses grid cells of sampled bits, drawn
from a seeded generator: 40 cells of 16 bits up to a million fingerprints, and more and
finer ones beyond (``sampling``), so that a cell's mean stays below 16 fingerprints.  Two texts of
similarity 0.8 meet in at least one cell with a chance of 95 %, of 0.9 with over 99.9 %.
Pairs of a cell with at most ``MAX_BITS`` differing bits are close.  The nearest neighbours' tree over
a cell's close pairs is verified first, on the exact shingle sets.  Then, in rounds, so is every other close
pair whose ends aren't joined by verified pairs yet: in families of texts that look alike but aren't, the
tree may consist of pairs that fail.  A round takes from a cell of n fingerprints at most a fixed multiple of n pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded, limit_batches, materialize, parallelism
from quillspark.llm.components import connected_components
from quillspark.llm.simhash import near_duplicates

LANES = 4
#: Chance that two texts of similarity 0.8 differ in a bit, and that they meet in no cell.
DIFFER, MISSED = 0.1513, 0.05
#: Differing bits of 256 up to which a pair is verified: texts of similarity 0.8 differ in 39 on average.
MAX_BITS = 50
#: Rows of sampled cells that one task holds at a time (whole cells).
CELL_ROWS = 200_000
#: Fingerprints in a cell above which its pairs are worked through in blocks.
BLOCK = 512
#: Each round of further pairs reaches so many times as far along the rows of a cell as the one before.
REACH = 8
#: Ids up to which a set of them is broadcast (16 bytes each); beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000


def sampling(n: int) -> np.ndarray:
    """Sampled bits of each kind of cell, for ``n`` fingerprints: one row a cell."""
    bits = 16 + max(0, (max(n, 1) - 1).bit_length() - 20)
    cells = math.ceil(math.log(MISSED) / math.log1p(-((1 - DIFFER) ** bits)))
    return np.stack([np.random.default_rng(k).choice(64 * LANES, bits, replace=False) for k in range(cells)])


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text (fewer words: the whole sequence)."""
    from xxhash import xxh64_intdigest as xxh64

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.array([xxh64(s, 42) for s in shingles], np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """256 bits: each lane is the bitwise majority of the hashes, mixed for the lane."""
    out = []
    for lane in range(LANES):
        mixed = hashes
        if lane:
            mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * lane & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(29)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(mixed), 1 << 15):
            ones += np.unpackbits(mixed[at : at + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        out.append(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes())
    return b"".join(out)


def wide_fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """``key, ord, fp`` of every row; the key is the hash of its set of shingles."""
    from xxhash import xxh64_intdigest as xxh64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            keys, fps = [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, size)
                keys.append(xxh64(hashes.tobytes()))
                fps.append(wide_fingerprint(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), batch.column(0), pa.array(fps, pa.binary())], ["key", "ord", "fp"])

    return docs.select("ord", "text").mapInArrow(run, "key bigint, ord bigint, fp binary")


def sampled_cells(points: DataFrame, samples: np.ndarray) -> DataFrame:
    """``cell, key, fp`` and any other columns: each fingerprint in each of its cells."""
    count, width = samples.shape
    points = points.select("key", "fp", *(c for c in points.columns if c not in ("key", "fp")))
    names = ["cell", *points.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                n = part.num_rows
                bits = np.unpackbits(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8), bitorder="little").reshape(n, -1)
                cells = [(bits[:, s] @ (1 << np.arange(width))) | k << width for k, s in enumerate(samples)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), *(pa.concat_arrays([c] * count) for c in part.columns)], names)

    return points.mapInArrow(run, ", ".join(["cell bigint", *(f"{c} {t}" for c, t in points.dtypes)]))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def cell_trees(cell: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs that join each cell's close fingerprints, nearest first;
    rows are sorted by cell."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    close_i, close_j, close_d = [], [], []
    size_of = np.repeat(sizes, sizes)
    for step in range(1, int(min(BLOCK, sizes.max()))):
        i = np.flatnonzero((cell[:-step] == cell[step:]) & (size_of[:-step] <= BLOCK))
        d = _distances(fps[i], fps[i + step])
        ok = d <= MAX_BITS
        close_i.append(i[ok]), close_j.append(i[ok] + step), close_d.append(d[ok])
    for start, size in zip(starts[sizes > BLOCK], sizes[sizes > BLOCK]):
        # a crowded cell: each block keeps its close pairs only until its own tree is made
        for a in range(start, start + size, BLOCK):
            for b in range(a, start + size, BLOCK):
                x, y = fps[a : min(a + BLOCK, start + size)], fps[b : min(b + BLOCK, start + size)]
                i, j = np.nonzero(_distances(x[:, None], y[None, :]) <= MAX_BITS)
                i, j = i + a, j + b
                keep = i < j
                i, j = _tree(i[keep], j[keep], _distances(fps[i[keep]], fps[j[keep]]))
                close_i.append(i), close_j.append(j), close_d.append(_distances(fps[i], fps[j]))
    if not close_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _tree(*(np.concatenate(x) for x in (close_i, close_j, close_d)))


def _tree(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a minimum spanning forest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    keep = []
    for k in np.argsort(d, kind="stable").tolist():
        a, b = find(int(i[k])), find(int(j[k]))
        if a != b:
            parent[b] = a
            keep.append(k)
    return i[keep], j[keep]


def open_pairs(cell: np.ndarray, fps: np.ndarray, label: np.ndarray, samples: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Positions (i, j) of the close pairs with different labels that stand ``low`` to ``high`` - 1 rows apart in a
    cell, and None at the end where farther ones are left; rows are sorted by cell.  A pair is
    given only in the first of the cells in which it meets."""
    masks = np.zeros((len(samples), 64 * LANES), np.uint8)
    np.put_along_axis(masks, samples, 1, 1)
    masks = np.packbits(masks, axis=1, bitorder="little").view(np.uint64)
    kind = cell >> samples.shape[1]
    after = np.searchsorted(cell, cell, "right") - np.arange(len(cell))  # rows to the end of the cell
    i, step = np.arange(len(cell)), low
    while len(i := i[after[i] > step]):
        x = i[label[i] != label[i + step]]
        differ = fps[x] ^ fps[x + step]
        ok = np.bitwise_count(differ).sum(-1, dtype=np.int64) <= MAX_BITS
        x, differ = x[ok], differ[ok]
        for k, mask in enumerate(masks[:-1]):
            if not len(x):
                break
            first = (kind[x] <= k) | (differ & mask).any(1)
            x, differ = x[first], differ[first]
        if len(x):
            if step >= high:
                yield None
                return
            yield x, x + step
        step += 1


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of ``sampled_cells`` as arrays, some whole cells at a time."""
    held, size = [], 0
    for batch in batches:
        held.append([np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, LANES) if n == "fp" else c.to_numpy() for n, c in zip(batch.schema.names, batch.columns)])
        size += batch.num_rows
        if size >= CELL_ROWS:
            columns = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield [c[:cut] for c in columns]
            held, size = [[c[cut:] for c in columns]], size - cut
    if size:
        yield [np.concatenate(x) for x in zip(*held)]


def _dealt(points: DataFrame, samples: np.ndarray) -> DataFrame:
    parts = max(parallelism(points.sparkSession), 1)
    return sampled_cells(points, samples).repartition(parts, "cell").sortWithinPartitions("cell", "key")


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def candidate_pairs(points: DataFrame, samples: np.ndarray) -> DataFrame:
    """``a, b`` (a < b): keys whose fingerprints are joined in some cell's tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, key, fps in _whole_cells(batches):
            i, j = cell_trees(cell, fps)
            yield _pair_batch(key[i], key[j])

    return _dealt(points, samples).mapInArrow(run, "a bigint, b bigint").distinct()


def further_pairs(points: DataFrame, samples: np.ndarray, low: int, high: int) -> DataFrame:
    """``a, b`` (a < b): keys of ``open_pairs`` of points with a ``label``; NULLs where more are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, key, fps, label in _whole_cells(batches):
            for pair in open_pairs(cell, fps, label, samples, low, high):
                if pair is None:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 2, ["a", "b"])
                else:
                    yield _pair_batch(key[pair[0]], key[pair[1]])

    return _dealt(points, samples).mapInArrow(run, "a bigint, b bigint").distinct()


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``ord, key, component``: rows (``ord``, ``text``) with the key of their shingle set and the
    least key of its group (the own key where it is alike to no other)."""
    limit_batches(docs.sparkSession)
    rows = materialize(wide_fingerprints(docs, size), "op8-wide")
    points = rows.groupBy("key").agg(F.first("fp").alias("fp"), F.min("ord").alias("first_ord"))
    points = materialize(points, "op8-wide-points")
    samples = sampling(points.count())
    pairs = materialize(candidate_pairs(points.select("key", "fp"), samples), "op8-candidates")
    # texts of the keys that are in any pair, one row for each key
    involved = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(points.select("key", "first_ord"), "key").select("key", F.col("first_ord").alias("ord"))
    involved = materialize(involved, "op8-involved")
    few = F.broadcast(involved) if involved.count() <= BROADCAST_ROWS else involved
    sets = docs.select("ord", "text").join(few, "ord").select("key", "text")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xxh64

        for batch in bounded(batches):
            sets = [shingle_hashes(t, size) for t in batch.column(1).to_pylist()]
            # rows that share the ord but not the set are told apart by the set's own key
            keep = [i for i, (s, k) in enumerate(zip(sets, batch.column(0).to_pylist())) if xxh64(s.tobytes()) == k & 0xFFFFFFFFFFFFFFFF]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["key", "hashes"])

    sets = materialize(sets.mapInArrow(hashes, "key bigint, hashes binary").dropDuplicates(["key"]), "op8-sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("key").alias("b"), F.col("hashes").alias("y"))
    verified_of = lambda pairs: pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint")
    verified = materialize(verified_of(pairs), "op8-verified")
    label = connected_components(verified).withColumnRenamed("node", "key")
    # a key that is in no tree has no close pair at all
    near = materialize(points.select("key", "fp").join(few.select("key"), "key"), "op8-near")
    low, high, more = 1, REACH, True
    while more:
        labelled = near.join(label, "key", "left").select("key", "fp", F.coalesce("component", "key").alias("label"))
        found = materialize(further_pairs(labelled, samples, low, high), "op8-further")
        more = not found.where("a is null").isEmpty()
        new = materialize(verified_of(found.where("a is not null")), "op8-verified")
        if not new.isEmpty():
            verified = verified.unionByName(new)
            label = connected_components(verified).withColumnRenamed("node", "key")
        low, high = high, high * REACH
    return rows.select("ord", "key").join(label, "key", "left").select("ord", "key", F.coalesce("component", "key").alias("component"))


def keep_one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8, words_in_shingle: int | None = None) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, with all columns: of each group of rows
    joined by word-shingle similarity, the one of least doc_id stays.

    With ``words_in_shingle``, rows that ``simhash.near_duplicates`` links are joined as well: a group is
    what can be reached by links of either kind.

    NULL and empty texts are a group of their own.  NULL ids come last; of repeated or equal ids the row of
    least text hash stays, and of identical rows one.  An empty table gives an empty table.
    """
    last = (1 << 63) - 1
    keyed = docs.withColumn("__ord", F.xxhash64("doc_id", "text"))
    rows = keyed.select(F.col("__ord").alias("ord"), "text")
    linked = near_duplicates(rows.withColumnRenamed("ord", "doc_id"), words_in_shingle).select(F.col("doc_id").alias("ord"), F.col("component_id").alias("near")).distinct() if words_in_shingle else None
    groups = similar_groups(rows, size, similarity).select("ord", "component").distinct()
    if linked is not None:
        groups = materialize(_united(groups, linked), "op8-united")
    ids = keyed.select(F.col("__ord").alias("ord"), F.struct(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(last)).alias("i"), F.col("__ord").alias("o")).alias("rank")).distinct()
    chosen = groups.join(ids, "ord").groupBy("component").agg(F.min("rank").alias("rank")).select(F.col("rank.o").alias("__ord"))
    chosen = materialize(chosen, "op8-kept")
    return keyed.join(chosen, "__ord", "left_semi").dropDuplicates(["__ord"]).drop("__ord")


def _united(groups: DataFrame, linked: DataFrame) -> DataFrame:
    """``ord, component``: rows grouped by ``component`` of the first or ``near`` (the least ``ord`` reached) of the second."""
    own = groups.groupBy("component").agg(F.min("ord").alias("a"))
    both = materialize(groups.join(own, "component").select("ord", "a").join(linked, "ord").select("ord", "a", F.col("near").alias("b")), "op8-both")
    label = connected_components(both.select("a", "b")).withColumnRenamed("node", "a")
    return both.join(label, "a", "left").select("ord", F.coalesce("component", "a").alias("component"))
