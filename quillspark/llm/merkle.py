"""A Merkle manifest of a dataset, with the authentication path of every row.

Every row is a leaf; the leaves of one language, in the order of doc_id, make a tree, and
the trees' roots in the order of the languages make the last tree.  Consecutive pairs become
the digest of their digests' hex text, a last node without a partner the digest of its own.

A tree is cut into aligned blocks of ``2**BLOCK`` nodes.  Upwards, each block's root is
computed by a task that holds one stack of at most ``BLOCK`` digests; the roots are the nodes
of the next tier, and so on until one is left.  Downwards, a task walks a block by fractal
traversal (Jakobsson, Leighton, Micali and Szydlo, 2003): the block's height is cut into
bands of ``BAND`` levels; each band keeps an *existing* subtree, from which the paths of the
leaves below it are read, and a *desired* one, its right neighbour, which grows by one leaf
with each path that is put out and takes its place when the walk crosses over.  The proof of
the block itself, made in the tier above, comes as a row before the block's and is appended.

So a block's rows are the largest group that meets in a task, whatever a language's share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import drop_table, materialize, parallelism

#: Logarithm of the nodes in a block.
BLOCK = 12
#: Levels of a band of subtrees.
BAND = 3
#: First byte of a proof's step: the sibling stands at the left, at the right, or isn't there.
LEFT, RIGHT, ALONE = b"\0", b"\1", b"\2"


def digest(*parts: bytes) -> bytes:
    """SHA-256 of the hex texts of digests, one after another."""
    return sha256(b"".join(parts).hex().encode()).digest()


def height(n: int, most: int) -> int:
    """Levels above ``n`` nodes until one is left, ``most`` at most."""
    return min(most, max(0, n - 1).bit_length())


class Stack:
    """Treehash: takes the leaves of one subtree in order and merges as it goes.

    ``node(level, index, digest)`` is told of every node that comes to be, leaves included.
    """

    def __init__(self, node: Callable[[int, int, bytes], None] | None = None):
        self.stack: list[tuple[int, int, bytes]] = []
        self.node = node or (lambda *_: None)

    def add(self, index: int, leaf: bytes) -> None:
        new = (0, index, leaf)
        self.node(*new)
        while self.stack and self.stack[-1][0] == new[0]:
            level, i, left = self.stack.pop()
            new = (level + 1, i >> 1, digest(left, new[2]))
            self.node(*new)
        self.stack.append(new)

    def close(self, top: int) -> bytes:
        """The root at level ``top``; nodes without a partner are hashed alone on the way."""
        level, index, value = self.stack.pop()
        while level < top:
            if self.stack and self.stack[-1][0] == level:
                value = digest(self.stack.pop()[2], value)
            else:
                value = digest(value)
            level, index = level + 1, index >> 1
            self.node(level, index, value)
        return value


def block_root(leaves: list[bytes], top: int) -> bytes:
    stack = Stack()
    for i, x in enumerate(leaves):
        stack.add(i, x)
    return stack.close(top)


class Subtree:
    """The nodes of levels ``low`` to ``high`` - 1 below node ``index`` of level ``high``, fed leaf by leaf.

    What is below ``low`` is merged in the stack and let go.
    """

    def __init__(self, low: int, high: int, index: int, n_leaves: int):
        self.low, self.high = low, high
        self.next, self.end = index << high, min((index + 1) << high, n_leaves)
        self.nodes: dict[tuple[int, int], bytes] = {}
        self.stack = Stack(self._keep)

    def _keep(self, level: int, index: int, value: bytes) -> None:
        if self.low <= level < self.high:
            self.nodes[level, index] = value

    def grow(self, leaves: list[bytes]) -> None:
        """One more leaf, if one is left; the last also closes the subtree."""
        if self.next < self.end:
            self.stack.add(self.next, leaves[self.next])
            self.next += 1
            if self.next == self.end:
                self.stack.close(self.high)


def traverse(leaves: list[bytes], top: int, band: int = BAND) -> Iterator[list[bytes]]:
    """The steps from each leaf of a block, in order, up to the block's root at level ``top``.

    At any time two subtrees a band are held, each of fewer than ``2**(band + 1)`` nodes and
    a stack of at most ``top``; the leaves themselves are only read in order, by each band.
    """
    n = len(leaves)
    bands = [(low, min(low + band, top)) for low in range(0, top, band)]
    existing, desired = [], []
    for low, high in bands:
        first = Subtree(low, high, 0, n)
        while first.next < first.end:
            first.grow(leaves)
        existing.append(first.nodes)
        desired.append(Subtree(low, high, 1, n))
    for i in range(n):
        steps = []
        for (low, high), nodes in zip(bands, existing):
            for level in range(low, high):
                at = i >> level
                sibling = nodes.get((level, at ^ 1))
                steps.append(ALONE if sibling is None else (LEFT if at & 1 else RIGHT) + sibling)
        yield steps
        for k, (low, high) in enumerate(bands):
            desired[k].grow(leaves)
            if (i + 1) & ((1 << high) - 1) == 0:
                existing[k] = desired[k].nodes
                desired[k] = Subtree(low, high, ((i + 1) >> high) + 1, n)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of each block, which come in the order of ``key, block, pos``."""
    rows = (r for batch in batches for r in batch.to_pylist())
    return ((at, list(own)) for at, own in groupby(rows, lambda r: (r["key"], r["block"])))


def _by_block(nodes: DataFrame, block: int) -> DataFrame:
    """Blocks whole and in order, dealt over the tasks by key and block."""
    dealt = nodes.withColumn("block", F.shiftright("pos", block))
    return dealt.repartition(parallelism(nodes.sparkSession), "key", "block").sortWithinPartitions("key", "block", "pos")


def _up(nodes: DataFrame, block: int) -> DataFrame:
    """The next tier: ``key, pos, n, digest`` of the blocks of ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, at), rows in _blocks(batches):
            n = rows[0]["n"]
            root = block_root([r["digest"] for r in rows], height(n, block))
            yield pa.RecordBatch.from_pylist([{"key": key, "pos": at, "n": -(-n >> block), "digest": root}], schema)

    schema = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
    return _by_block(nodes.select("key", "pos", "n", "digest"), block).mapInArrow(run, "key string, pos bigint, n bigint, digest binary")


def _down(nodes: DataFrame, above: DataFrame, extra: list[str], block: int) -> DataFrame:
    """``key, pos, n, digest, proof, subroot, root`` and the ``extra`` columns of every node.

    ``above`` has the proofs of the blocks (their places as ``pos``): each becomes a row
    before its block's, so that rows and proof meet in one shuffle and the proof is there once.
    """
    kinds = dict(nodes.dtypes)
    plain, given = ["n", "digest", *extra], {"upper": "array<binary>", "subroot": "binary", "root": "binary"}
    own = nodes.select("key", F.shiftright("pos", block).alias("block"), "pos", *plain, *(F.lit(None).cast(t).alias(c) for c, t in given.items()))
    lead = above.select("key", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), *(F.lit(None).cast(kinds[c]).alias(c) for c in plain), F.col("proof").alias("upper"), "subroot", "root")
    dealt = own.unionByName(lead).repartition(parallelism(nodes.sparkSession), "key", "block").sortWithinPartitions("key", "block", "pos")
    arrow = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    kept = ["key", "pos", *plain]
    names, types = [*kept, "proof", "subroot", "root"], [*(arrow[kinds[c]] for c in kept), pa.list_(pa.binary()), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (lead, *rows) in _blocks(batches):
            steps = [own + lead["upper"] for own in traverse([r["digest"] for r in rows], height(rows[0]["n"], block))]
            columns = [*([r[c] for r in rows] for c in kept), steps, [lead["subroot"]] * len(rows), [lead["root"]] * len(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names)

    return dealt.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", proof array<binary>, subroot binary, root binary")


def tiers(nodes: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """``nodes`` (``key, pos`` from 0, ``n`` of its key, ``digest``), their blocks' roots, and so
    on; the last has one node for each key."""
    found = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        found.append(materialize(_up(found[-1], block), "op13-tier"))
        most = -(-most >> block)
    return found


def descend(levels: list[DataFrame], top: DataFrame, extra: list[str], block: int = BLOCK) -> DataFrame:
    """The proofs of the first tier's nodes from those of the last tier's, which ``top`` has."""
    for k in range(len(levels) - 2, -1, -1):
        top = _down(levels[k], top, extra if k == 0 else [], block)
    return top


def numbered(rows: DataFrame, order: list[Column], keep: list[str]) -> DataFrame:
    """``rows`` with ``pos`` within their ``key`` in the given order, from 0, and ``n`` of it.

    Range-sorted once and written; only the counts of (partition, key) are summed over
    partitions, and no key's rows meet in one task.
    """
    parts = parallelism(rows.sparkSession)
    ranged = rows.repartitionByRange(parts, F.col("key").asc_nulls_first(), *order).sortWithinPartitions(F.col("key").asc_nulls_first(), *order)
    fixed = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "op13-ranged")
    part = F.shiftright("at", 33)
    counts = fixed.groupBy(part.alias("part"), "key").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    before = F.sum("here").over(Window.partitionBy("key").orderBy("part")) - F.col("here")
    shifts = counts.select(F.col("part").alias("part_"), F.col("key").alias("key_"), (before - F.col("first")).alias("shift"), F.sum("here").over(Window.partitionBy("key")).alias("n"))
    joined = fixed.join(shifts, (part == F.col("part_")) & fixed["key"].eqNullSafe(F.col("key_")))
    placed = materialize(joined.select("key", (F.col("at") + F.col("shift")).alias("pos"), "n", *keep), "op13-placed")
    drop_table(fixed)
    return placed


def leaf(**changed: Column) -> Column:
    """Hex digest of a row: doc_id, source, lang, n_chars and text, each ``-`` if NULL, else its
    UTF-8 byte count, ``:`` and its value.  Keyword arguments stand for changed columns."""
    parts = []
    for name in ("doc_id", "source", "lang", "n_chars", "text"):
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def prove(docs: DataFrame, claimed: Column | None = None, block: int = BLOCK) -> DataFrame:
    """``doc_id, lang, leaf, claimed, proof, subroot, root`` of every row.

    Digests are lowercase hex text.  ``proof`` holds the steps from the leaf over its
    language's subroot to the root: the side of the sibling (``LEFT``, ``RIGHT``, ``ALONE``)
    and, but for ``ALONE``, its 32 bytes.  ``claimed`` is an optional other leaf that goes
    along for ``fold``; blocks have ``2**block`` nodes.

    Rows of equal doc_id are ordered by their leaves and repeated rows are leaves of their
    own; NULL ids come first, NULL languages are a language of their own before the others,
    NULL and empty texts have different leaves.  A text of any length is hashed where it is
    read.  An empty table gives an empty table; other columns are ignored, whatever their names.
    """
    other = claimed if claimed is not None else F.lit(None).cast("string")
    leaves = materialize(docs.select("doc_id", F.col("lang").alias("key"), F.unhex(leaf()).alias("digest"), F.unhex(other).alias("claimed")), "op13-leaves")
    placed = numbered(leaves, [F.col("doc_id").asc_nulls_first(), F.col("digest")], ["digest", "doc_id", "claimed"])
    drop_table(leaves)
    levels = tiers(placed, block)
    subroots = levels[-1].select(F.lit("").alias("key"), F.col("key").alias("lang"), "digest")
    languages = tiers(numbered(subroots, [F.col("lang").asc_nulls_first()], ["lang", "digest"]), block)
    alone = F.array().cast("array<binary>").alias("proof")
    last = languages[-1].select(*languages[-1].columns, alone, F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    upper = descend(languages, last, ["lang"], block).select("lang", "proof", F.col("digest").alias("subroot"), "root")
    top = levels[-1].join(upper, levels[-1]["key"].eqNullSafe(upper["lang"])).drop("lang")
    whole = descend(levels, top, ["doc_id", "claimed"], block)
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return whole.select("doc_id", F.col("key").alias("lang"), text("digest").alias("leaf"), text("claimed"), "proof", text("subroot"), text("root"))


def fold(leaf: Column, proof: Column) -> Column:
    """Root that a leaf's hex digest leads to along a proof."""

    def step(value: Column, s: Column) -> Column:
        sibling = F.lower(F.hex(F.substring(s, 2, 32)))
        side = F.substring(s, 1, 1)
        both = F.when(side == F.lit(LEFT), F.concat(sibling, value)).when(side == F.lit(RIGHT), F.concat(value, sibling)).otherwise(value)
        return F.sha2(both.cast("binary"), 256)

    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """Digest of the siblings' hex texts, from the leaf to the root."""
    return F.sha2(F.lower(F.concat_ws("", F.transform(proof, lambda s: F.hex(F.substring(s, 2, 32))))).cast("binary"), 256)
