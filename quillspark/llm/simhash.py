"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits.  Its embedding is the vector of
their bit counts (0, 1 or 2).  Flipping one bit moves the vector by one, so the Manhattan
distance of two embeddings is a lower bound of the fingerprints' Hamming distance.  Two
fingerprints within distance 3 are within Manhattan distance 1 in the first or in the
second half of the segments.  The grid has one cell for each half-vector (16 coordinates in
base 3, so 3**16 cells a half); the range join probes, for each fingerprint, its own cell
and the cells one step away.  The exact Hamming distance is verified inside the join, so
only true links leave it.  Equal fingerprints are one grid point, however many rows have them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded, limit_batches, materialize
from quillspark.llm.components import connected_components

SEED = 42
#: Largest number of differing bits of a link.  The halves' radius of 1 covers up to 3.
MAX_BITS = 3


def fingerprint(text: str | None, words_in_shingle: int) -> int:
    """Fingerprint of one text as an unsigned number; 0 where there is no word."""
    from xxhash import xxh64_intdigest as xxh64

    words = (text or "").encode().lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    if len(words) < words_in_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_in_shingle))))
    hashes = np.array([xxh64(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` holds the 64 bits as a signed long."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            fps = np.array([fingerprint(t, words_in_shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp bigint")


def grid_points(points: DataFrame, probe: bool) -> DataFrame:
    """``half, cell, fp``: the two cells of each fingerprint, and with ``probe`` also the
    cells one step away in either direction."""
    places = 3 ** np.arange(16, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fps = batch.column(0)[at : at + 20_000].to_numpy(zero_copy_only=False)
                bits = np.unpackbits(fps.astype("<i8").view(np.uint8), bitorder="little").reshape(-1, 32, 2)
                counts = bits.sum(2, dtype=np.int64)
                out = []
                for half in (0, 1):
                    own = counts[:, 16 * half : 16 * half + 16]
                    cell = own @ places
                    out.append((half, cell, fps))
                    if probe:
                        for j in range(16):
                            up, down = own[:, j] < 2, own[:, j] > 0
                            out += [(half, cell[up] + places[j], fps[up]), (half, cell[down] - places[j], fps[down])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([h for h, _, _ in out], [len(c) for _, c, _ in out]).astype(np.int32)), pa.array(np.concatenate([c for _, c, _ in out])), pa.array(np.concatenate([f for _, _, f in out]))],
                    ["half", "cell", "fp"],
                )

    return points.select("fp").mapInArrow(run, "half int, cell bigint, fp bigint")


def links(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b`` (a < b): pairs of different fingerprints of ``points`` (one row each) at
    Hamming distance of at most ``max_bits``."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    cells = grid_points(points, probe=False).withColumnRenamed("fp", "a")
    probes = grid_points(points, probe=True).withColumnRenamed("fp", "b")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return cells.hint("merge").join(probes, (cells["half"] == probes["half"]) & (cells["cell"] == probes["cell"]) & (F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words_in_shingle: int = 5, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id, n_links``: every row with its group.

    Rows whose fingerprints differ in at most ``max_bits`` bits are linked;
    ``component_id`` is the smallest doc_id that can be reached (the row's own if nothing
    else).  ``n_links`` counts other fingerprints that the row's is linked to; rows of equal
    fingerprint are in one component without being paired.

    NULL and empty texts have fingerprint 0 and are linked like any other.  Repeated rows
    stay; NULL ids are grouped, and only a group without any other id has a NULL
    component_id.  An empty table gives an empty table; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, words_in_shingle), "op8-fp")
    points = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    points = materialize(points, "op8-points")
    pairs = materialize(links(points, max_bits), "op8-links")
    label = connected_components(pairs.select("a", "b"))
    first = points.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    groups = first.groupBy("group").agg(F.min("first_id").alias("component_id"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    known = first.select("fp", "group").join(groups, "group").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.join(known, "fp").select("doc_id", "fp", "component_id", "n_links")
