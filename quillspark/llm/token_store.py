"""Token ids in directly addressable codes.

File format ``QDAC`` (all integers little-endian).  A store is a Parquet dataset with one
row per shard; the shard's payload holds the ids of consecutive documents::

    magic "QDAC", u16 version, u16 levels, u64 n_docs, u64 n_ids
    (n_docs + 1) u64            first id of each document within the shard
    for each level:
        u64 n                   entries of the level
        n bytes                 one 8-bit chunk of each id that reaches the level
        ceil(n / 64) u64        continuation bitmap: the id goes on at the next level
        ceil(n / 512) + 1 u32   rank directory: continuation bits before each 512-bit block

Chunk i of level 0 belongs to id i.  If its continuation bit is set, its next chunk stands
at position rank(i) of level 1, and so on; rank takes one directory entry and at most
eight words, so any id is read in a constant number of steps without decoding a block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bpe import PART_BYTES, worker_encoder
from quillspark.llm.common import bounded, parallelism, scratch_path

MAGIC, VERSION = b"QDAC", 1
#: Ids in a shard; a longer document has a shard of its own.
SHARD_IDS = 1 << 20
_HEAD = struct.Struct("<4sHHQQ")
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """Payload of a shard: ``ids`` of all its documents, ``starts`` with n_docs + 1 entries."""
    out, levels, rest = [], 0, ids.astype(np.uint32)
    while levels == 0 or len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(rest) // 64) * 8, np.uint8)
        words[: len(bits)] = bits
        blocks = -(-len(rest) // 512)
        padded = np.zeros(blocks * 64, np.uint8)
        padded[: len(bits)] = bits
        ranks = np.zeros(blocks + 1, "<u4")
        ranks[1:] = np.cumsum(_POP[padded].reshape(blocks, 64).sum(1, dtype=np.uint32)) if blocks else []
        out += [struct.pack("<Q", len(rest)), rest.astype(np.uint8).tobytes(), words.tobytes(), ranks.tobytes()]
        rest, levels = rest[more] >> 8, levels + 1
    return b"".join([_HEAD.pack(MAGIC, VERSION, levels, len(starts) - 1, len(ids)), starts.astype("<u8").tobytes(), *out])


class TokenShard:
    """Reads one payload."""

    def __init__(self, payload: bytes):
        magic, version, levels, self.n_docs, self.n_ids = _HEAD.unpack_from(payload)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a QDAC shard")
        at = _HEAD.size
        self.starts = np.frombuffer(payload, "<u8", self.n_docs + 1, at)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            at += 8
            chunks = np.frombuffer(payload, np.uint8, n, at)
            at += n
            bits = np.frombuffer(payload, np.uint8, -(-n // 64) * 8, at)
            at += len(bits)
            ranks = np.frombuffer(payload, "<u4", -(-n // 512) + 1, at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def rank(self, level: int, i: int) -> int:
        """Continuation bits before entry ``i`` of a level: one directory entry and at most 64 bytes of bits."""
        _, bits, ranks = self.levels[level]
        count = int(ranks[i >> 9]) + int(_POP[bits[i >> 9 << 6 : i >> 3]].sum())
        return count + int(_POP[bits[i >> 3] & ((1 << (i & 7)) - 1)]) if i & 7 else count

    def token(self, i: int) -> int:
        """Id number ``i`` of the shard, by rank alone."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self.rank(level, i)
        return value

    def run(self, first: int, end: int) -> np.ndarray:
        """Ids ``first`` to ``end`` (exclusive): a run of entries goes on as one run of each
        next level, whose start the rank directory gives, so nothing else is touched."""
        if not 0 <= first <= end <= self.n_ids:
            raise IndexError((first, end))
        steps = []
        for level, (chunks, bits, _) in enumerate(self.levels):
            if first == end:
                break
            more = np.unpackbits(bits[first >> 3 : (end + 7) >> 3], bitorder="little")[first & 7 :][: end - first].view(bool)
            steps.append((chunks[first:end].astype(np.uint32), more))
            first = self.rank(level, first)
            end = first + int(np.count_nonzero(more))
        value = np.zeros(0, np.uint32)
        for here, more in reversed(steps):
            here[more] |= value << np.uint32(8)
            value = here
        return value

    def all(self) -> np.ndarray:
        return self.run(0, self.n_ids)

    def document(self, k: int) -> np.ndarray:
        return self.run(int(self.starts[k]), int(self.starts[k + 1]))


def write_token_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text, append ``end_id`` to each document and write a store in
    ascending doc_id order.

    NULL and empty texts hold the end id alone.  NULL ids come first.  Rows of equal doc_id
    are ordered by their text, and equal rows are all kept.  An empty table writes an empty
    store.  Texts are range-shuffled once and encoded where they are packed; ties on doc_id are
    dealt by a hash of the text, so that no key gathers in one task unless its rows are identical.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(to_arrow_type(docs.schema["doc_id"].dataType))), ("payload", pa.binary())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = worker_encoder(tokenizer_path)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held, names, size = [], [], 0
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, held, names, size
            ids = np.concatenate([x for pair in held for x in (pair, end)])
            starts = np.cumsum([0, *(len(x) + 1 for x in held)])
            row = {"part": [part], "seq": [seq], "before": [before], "n_ids": [len(ids)], "doc_ids": [names], "payload": [pack(ids, starts)]}
            seq, before, held, names, size = seq + 1, before + len(ids), [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=arrow)

        for batch in bounded(batches, most=PART_BYTES):
            for name, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                if held and size + len(ids) + 1 > shard_ids:
                    yield flush()
                held.append(ids)
                names.append(name)
                size += len(ids) + 1
        if held:
            yield flush()

    parts = max(parallelism(spark), docs.count() // 50_000)
    key = F.col("doc_id").asc_nulls_first()
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, key, F.xxhash64("text")).sortWithinPartitions(key, F.xxhash64("text"), "text")
    packed = ordered.mapInArrow(shards, f"part int, seq int, before bigint, n_ids bigint, doc_ids array<{kind}>, payload binary")
    # payloads as they are: what stands in the file is what is addressed, with nothing to unpack first
    packed.write.option("compression", "none").option("parquet.enable.dictionary", "false").option("parquet.block.size", str(32 << 20)).parquet(path)


def _bases(spark: SparkSession, store: DataFrame) -> DataFrame:
    """``part, base``: the ids before each write partition.  One total a partition goes to the driver."""
    totals = sorted((r["part"], r["n"]) for r in store.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, before = [], 0
    for part, n in totals:
        bases.append((part, before))
        before += n
    return F.broadcast(spark.createDataFrame(bases, "part int, base bigint"))


def lookup_tokens(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """``position, token`` of each distinct global ``position`` (bigint) that the store holds.

    Positions find their shard by the stretch of ``SHARD_IDS`` ids that they lie in, an
    equi-join with the shards' heads alone; payloads are read only then, and each token by rank.
    NULL positions and those outside the store give no row.  Positions are held shard by
    shard, at most one for each id of a shard.
    """
    store = spark.read.parquet(path)
    first = F.col("base") + F.col("before")
    heads = store.join(_bases(spark, store), "part").select("part", "seq", first.alias("first"), (first + F.col("n_ids")).alias("end"))
    heads = heads.select("*", F.explode(F.sequence(F.floor(F.col("first") / SHARD_IDS), F.floor((F.col("end") - 1) / SHARD_IDS))).alias("stretch"))
    wanted = positions.select("position").distinct().withColumn("stretch", F.floor(F.col("position") / SHARD_IDS))
    hits = wanted.join(heads, "stretch").where("position >= first and position < end")
    by_shard = hits.groupBy("part", "seq", "first").agg(F.collect_list("position").alias("positions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, first = TokenShard(batch.column(2)[k].as_py()), batch.column(0)[k].as_py()
                at = batch.column(1)[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([shard.token(i - first) for i in at], pa.int64())], ["position", "token"])

    found = by_shard.join(store.select("part", "seq", "payload"), ["part", "seq"])
    return found.select("first", "positions", "payload").mapInArrow(read, "position bigint, token bigint")


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document, from the store's files.

    ``start`` counts the ids of all documents before it.  Only one total for each write
    partition goes to the driver, which bounds what is broadcast by the partition count.
    """
    store = spark.read.parquet(path)
    kind = dict(store.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = TokenShard(batch.column(2)[k].as_py())
                at = shard.starts.astype(np.int64)
                first = batch.column(0)[k].as_py()
                docs = batch.column(1)[k].values
                step = max(1, shard.n_docs * (1 << 18) // max(1, shard.n_ids))
                for i in range(0, shard.n_docs, step):
                    j = min(i + step, shard.n_docs)
                    ids, low = shard.run(int(at[i]), int(at[j])).astype("<u4"), int(at[i])
                    yield pa.RecordBatch.from_arrays(
                        [docs.slice(i, j - i), pa.array(first + at[i:j]), pa.array(at[i + 1 : j + 1] - at[i:j]), pa.array([ids[a - low : b - low].tobytes() for a, b in zip(at[i:j], at[i + 1 : j + 1])], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    rows = store.join(_bases(spark, store), "part").select((F.col("base") + F.col("before")).alias("first"), "doc_ids", "payload")
    return rows.mapInArrow(unpack, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


def encode_to_store(docs: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write a store (in the shared folder unless ``path`` is given) and read it back."""
    path = path or scratch_path(docs.sparkSession, "token-store")
    write_token_store(docs, path, tokenizer_path, end_id)
    return read_token_store(docs.sparkSession, path)
