"""Alignment of two tokenizers' ids on the bytes of a text, weighed by corpus-wide counts.

A text is encoded by a byte-level BPE (A, with a space before the text) and a sentencepiece
BPE (B, which adds that space itself).  Neither makes a token that spans a change from a
character that isn't white space to a space, so the text is cut there; each distinct piece
is encoded once and kept in a cache bounded in bytes.  The ids of a batch of texts stand one
after another, and offsets, groups, links and their text come from whole-array operations.

The pairs of ids that end together are packed into 64-bit keys, B's id above A's.  Each
task counts its own (``np.unique``) and puts out partial counts; these are range-partitioned
by key and sorted, and equal keys in a row are summed, which gives one sorted shard of
(key, count) a partition, written as a file to the shared folder.  A lookup maps the shards
that it needs into memory and finds keys by ``searchsorted``, so only pages that are touched
are read, whatever the table's size.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded, limit_batches, materialize, parallelism, scratch_path

#: Text bytes that are cut into pieces at a time.
PART_BYTES = 1 << 20
#: Bytes of the kept pieces of one Python worker, with ``PIECE_BYTES`` more for each; it starts anew beyond that.
CACHE_BYTES, PIECE_BYTES = 128 << 20, 240
#: Distinct keys that a task counts before it puts them out.
COUNTED_KEYS = 1 << 20
#: Links that are looked up at a time.
LOOKUP_LINKS = 1 << 20
_CUT = re.compile(r"(?<=\S) (?=[\s\S])")
#: A space after white space; texts without one are cut at every space.
_ODD = re.compile(r"\s ")
#: Fixed value: what sentencepiece writes for a space.
_SPACE = "▁"


@dataclass(frozen=True)
class Tokenizers:
    """Paths of the two vocabulary files, which each Python worker reads."""

    byte_level: str
    pieces: str


def byte_symbols() -> dict[str, int]:
    """Byte of each symbol of a byte-level vocabulary: printable Latin-1 characters are their own,
    the other bytes, in order, the characters from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Encodes and aligns pieces of text."""

    def __init__(self, tokenizers: Tokenizers):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(tokenizers.byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=tokenizers.pieces)
        spec = json.loads(self.a.to_str())
        if spec["normalizer"] or spec["pre_tokenizer"] != spec["pre_tokenizer"] | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError("the first tokenizer must be a plain byte-level one")
        symbols = byte_symbols()
        self.a_bytes = [bytes(symbols.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        texts = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace(_SPACE, " ").encode() for i, t in enumerate(texts)]
        if any(_SPACE in t.lstrip(_SPACE) for i, t in enumerate(texts) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))):
            raise ValueError("the second tokenizer has tokens that span words")
        if not all(self.a_bytes) or not all(self.b_bytes):
            raise ValueError("a token without bytes can't be aligned")
        if max(len(self.a_bytes), len(self.b_bytes)) > len(_decimals()[1]):
            raise ValueError("a vocabulary is too large for the table of digits")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.kept = 0
        self.ids = [np.zeros(1 << 16, np.int64) for _ in "ab"]
        self.used = [0, 0]
        self.starts, self.sizes = np.zeros((2, 0), np.int64), np.zeros((2, 0), np.int64)
        self.bad = np.zeros(0, bool)

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces, each with the space before it; they have the next slots in order."""
        ours = [e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
        theirs = self.b.encode(pieces, num_threads=1)
        want = [(" " + p).encode() for p in pieces]
        lengths = np.fromiter(map(len, want), np.int64, len(want))
        bad = np.zeros(len(pieces), bool)
        starts, sizes = [], []
        for k, (found, texts, size_of) in enumerate(((ours, self.a_bytes, self.a_sizes), (theirs, self.b_bytes, self.b_sizes))):
            n = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))
            ends = np.cumsum(n)
            covered = np.diff(np.concatenate([[0], np.cumsum(size_of[flat])])[ends], prepend=0)
            if not np.array_equal(covered, lengths) or b"".join(map(texts.__getitem__, flat.tolist())) != b"".join(want):
                bad |= np.fromiter((b"".join(map(texts.__getitem__, x)) != w for x, w in zip(found, want)), bool, len(want))
            starts.append(self.used[k] + ends - n)
            sizes.append(n)
            if self.used[k] + len(flat) > len(self.ids[k]):
                self.ids[k] = np.concatenate([self.ids[k][: self.used[k]], np.zeros(self.used[k] + 2 * len(flat), np.int64)])
            self.ids[k][self.used[k] : self.used[k] + len(flat)] = flat
            self.used[k] += len(flat)
        self.starts = np.concatenate([self.starts, starts], axis=1)
        self.sizes = np.concatenate([self.sizes, sizes], axis=1)
        self.bad = np.concatenate([self.bad, bad])
        self.kept += int(lengths.sum()) + PIECE_BYTES * len(pieces)

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray] | None]:
        """(A ids, B ids, groups, packed links) of each text; None where there are none."""
        if self.kept > CACHE_BYTES:
            self.forget()
        cut = [(_CUT.split(t) if t[-1] == " " or t[0] == " " or _ODD.search(t) else t.split(" ")) if t else [] for t in texts]
        slots, fresh = self.slots, []
        for pieces in cut:
            for p in pieces:
                if p not in slots:
                    slots[p] = len(slots)
                    fresh.append(p)
        if fresh:
            self.learn(fresh)
        n_pieces = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(slots.__getitem__, chain.from_iterable(cut)), np.int64, int(n_pieces.sum()))
        owner = np.repeat(np.arange(len(cut)), n_pieces)
        usable = n_pieces > 0
        usable[owner[self.bad[at]]] = False
        keep = usable[owner]
        at, owner = at[keep], owner[keep]
        a, b = (ragged(self.ids[k], self.starts[k][at], self.sizes[k][at]) for k in (0, 1))
        n_a, n_b = (np.bincount(owner, self.sizes[k][at], len(cut)).astype(np.int64) for k in (0, 1))
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)  # texts end there too, so groups don't cross them
        a_last, b_last = np.searchsorted(a_ends, both), np.searchsorted(b_ends, both)
        keys = b[b_last] << 32 | a[a_last]
        group_ends = np.cumsum(n_a)
        groups = np.searchsorted(a_last, group_ends - 1, side="right")  # groups up to the end of each text
        texts_, text_ends = rendered(a, b, a_last, b_last)
        firsts, byte_ends = np.concatenate([[0], groups[:-1]]), np.concatenate([[0], text_ends])
        for ok, x, y, low, high in zip(usable.tolist(), n_a.tolist(), n_b.tolist(), firsts.tolist(), groups.tolist()):
            yield (x, y, texts_[byte_ends[low] : max(byte_ends[low], byte_ends[high] - 1)], keys[low:high]) if ok else None


#: Row i has the decimal digits of i and room for a separator behind them; the second has the digits' number.
@cache
def _decimals() -> tuple[np.ndarray, np.ndarray]:
    ids = np.arange(1 << 17)
    digits = np.zeros((len(ids), 7), np.uint8)
    n = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 6))
    for k in range(6):
        own = n > k
        digits[own, k] = 48 + ids[own] // 10 ** (n[own] - 1 - k) % 10
    return digits, n


def ragged(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[starts[0] : starts[0] + sizes[0]] and so on, one after another."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def rendered(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;`` of every group, one after another, and where each group's text ends.

    ``a_last`` and ``b_last`` are the places of each group's last ids.
    """
    n_a, n_b = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
    before = np.cumsum(n_a + n_b) - n_a - n_b  # ids of the groups before
    ids, marks = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[np.arange(len(a)) + np.repeat(before - (a_last + 1 - n_a), n_a)] = a
    ids[np.arange(len(b)) + np.repeat(before + n_a - (b_last + 1 - n_b), n_b)] = b
    marks[before + n_a - 1], marks[before + n_a + n_b - 1] = ord("|"), ord(";")
    digits, n = _decimals()
    rows, sizes = digits[ids], n[ids] + 1
    rows[np.arange(len(ids)), sizes - 1] = marks
    ends = np.cumsum(sizes)
    return rows[np.arange(7) < sizes[:, None]].tobytes(), ends[before + n_a + n_b - 1] if len(ends) else ends


@cache
def worker_aligner(tokenizers: Tokenizers) -> Aligner:
    return Aligner(tokenizers)


def align(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups, links`` of every row.

    ``groups`` is text, ``a1,a2|b1;a3|b2,b3``: ids between neighbouring byte offsets where
    tokens of both end.  ``links`` holds the pairs that end together, in order, packed as
    little-endian 64-bit integers, B's id above 32 bits of A's; tokens have bytes, so one
    token of each ends at such an offset and there is a link a group.

    NULL and empty texts, and those whose tokens' bytes aren't a space and the text, have no
    tokens: zeros, empty groups and links.  Texts are aligned whole, whatever their length.
    Repeated rows each give a row, NULL ids stay, an empty table gives an empty table, and
    other columns are ignored.
    """
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_aligner(tokenizers)
        for batch in bounded(batches, most=PART_BYTES):
            found = [x or (0, 0, b"", np.zeros(0, np.int64)) for x in aligner.align(batch.column(1).to_pylist())]
            sizes = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
            n_groups = pa.array([len(x[3]) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, n_groups, pa.array([x[2] for x in found], pa.string()), pa.array([x[3].astype("<i8").tobytes() for x in found], pa.binary())], ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups string, links binary")


def partial_counts(links: DataFrame) -> DataFrame:
    """``key, n``: counts of the keys that each task has seen, several rows for a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in bounded(batches, "links"):
            new, n = np.unique(np.frombuffer(b"".join(x or b"" for x in batch.column(0).to_pylist()), "<i8"), return_counts=True)
            keys, counts = summed(np.concatenate([keys, new]), np.concatenate([counts, n]))
            if len(keys) > COUNTED_KEYS:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])
                keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    return links.select("links").mapInArrow(run, "key bigint, n bigint")


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    return run_sums(keys[order], counts[order])


def run_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of equal keys, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def _filesystem(path: str):
    """File system of a folder, and the folder's place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ShardWriter:
    """Appends sorted (key, count) runs; the file is two arrays, and has its name once it is whole."""

    def __init__(self, path: str):
        self.fs, self.path = _filesystem(path)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.keys, self.counts = self.fs.open_output_stream(f"{self.draft}.keys"), self.fs.open_output_stream(f"{self.draft}.counts")

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.write(keys.astype("<i8").tobytes())
        self.counts.write(counts.astype("<i8").tobytes())

    def close(self) -> None:
        for kind, stream in (("keys", self.keys), ("counts", self.counts)):
            stream.close()
            self.fs.move(f"{self.draft}.{kind}", f"{self.path}.{kind}")


def _mapped(path: str) -> np.ndarray:
    """A shard's array: mapped where it is if the folder is mounted here, else from a nameless copy."""
    from pyarrow import fs

    store, place = _filesystem(path)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(place, "<i8", "r") if os.path.getsize(place) else np.zeros(0, np.int64)
    with tempfile.TemporaryFile() as copy, store.open_input_stream(place) as source:
        while part := source.read(1 << 20):
            copy.write(part)
        copy.flush()
        return np.memmap(copy, "<i8", "r") if copy.tell() else np.zeros(0, np.int64)


@cache
def _shard(path: str) -> tuple[np.ndarray, np.ndarray]:
    return _mapped(f"{path}.keys"), _mapped(f"{path}.counts")


@dataclass(frozen=True)
class PairCounts:
    """The corpus-wide counts: shard files, the first key of each, and the highest count of each B id.

    On the driver and in each task are only ``shards`` and ``firsts``, a row for each
    partition, and ``best``, bounded by B's vocabulary.
    """

    folder: str
    shards: np.ndarray
    firsts: np.ndarray
    best_ids: np.ndarray
    best_counts: np.ndarray

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Counts of ``keys``, which must be sorted; 0 where a key has none."""
        out = np.zeros(len(keys), np.int64)
        owner = np.searchsorted(self.firsts, keys, side="right") - 1
        bounds = np.flatnonzero(np.diff(owner, prepend=-2, append=-2))
        for a, b in zip(bounds, bounds[1:]):
            if owner[a] >= 0:
                own, counts = _shard(f"{self.folder}/{self.shards[owner[a]]:06d}")
                at = np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)
                out[a:b] = np.where(own[at] == keys[a:b], counts[at], 0)
        return out

    def best(self, ids: np.ndarray) -> np.ndarray:
        """Highest count that each B id has with any A id."""
        return self.best_counts[np.searchsorted(self.best_ids, ids)]


def count_pairs(links: DataFrame) -> PairCounts:
    """Count every link of all rows, and write the sorted shards."""
    spark = links.sparkSession
    folder = scratch_path(spark, "op11-shards")
    ranged = partial_counts(links).repartitionByRange(parallelism(spark), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, first = TaskContext.get().partitionId(), None, None
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        best: dict[int, int] = {}
        for batch in _with_end(batches):
            if batch is not None:
                keys, counts = run_sums(np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([counts, batch.column(1).to_numpy()]))
            done = len(keys) if batch is None else len(keys) - 1  # the last run may go on
            if done <= 0:
                continue
            if writer is None:
                writer, first = ShardWriter(f"{folder}/{shard:06d}"), int(keys[0])
            writer.add(keys[:done], counts[:done])
            ids = keys[:done] >> 32
            starts = np.flatnonzero(np.diff(ids, prepend=-1))
            for b, n in zip(ids[starts].tolist(), np.maximum.reduceat(counts[:done], starts).tolist()):
                best[b] = max(n, best.get(b, 0))
            keys, counts = keys[done:], counts[done:]
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(best), pa.int64()), pa.array([first] * len(best), pa.int64()), pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())], ["shard", "first", "b", "n"])

    rows = materialize(ranged.mapInArrow(run, "shard bigint, first bigint, b bigint, n bigint"), "op11-directory")
    shards = sorted((r["first"], r["shard"]) for r in rows.groupBy("shard").agg(F.min("first").alias("first")).collect())
    best = sorted((r["b"], r["n"]) for r in rows.groupBy("b").agg(F.max("n").alias("n")).collect())
    columns = [np.array(x, np.int64).reshape(-1, 2) for x in (shards, best)]
    return PairCounts(folder, columns[0][:, 1], columns[0][:, 0], columns[1][:, 0], columns[1][:, 1])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def weigh_links(aligned: DataFrame) -> DataFrame:
    """``aligned`` with ``n_links, n_best, count_sum``: a row's links, those whose count is the
    corpus-wide highest of their B id (ties included), and the sum of the links' counts.

    ``aligned`` is written once and read twice; its ``links`` are as ``align`` makes them,
    and NULL counts as none.
    """
    fixed = materialize(aligned, "op11-links")
    counts = count_pairs(fixed)
    names = fixed.columns
    ddl = ", ".join(f"`{c}` {t}" for c, t in fixed.dtypes) + ", n_links bigint, n_best bigint, count_sum bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "links", most=8 * LOOKUP_LINKS):
            links = [np.frombuffer(x or b"", "<i8") for x in batch.column(names.index("links")).to_pylist()]
            sizes = np.array(list(map(len, links)), np.int64)
            keys, back = np.unique(np.concatenate(links), return_inverse=True)
            found = counts.lookup(keys)
            top = found == counts.best(keys >> 32) if len(keys) else np.zeros(0, bool)
            ends = np.cumsum(sizes)
            total = lambda x: np.concatenate([[0], np.cumsum(x[back])])[np.stack([ends - sizes, ends])]  # noqa: E731, B023
            (a, b), (c, d) = total(top.astype(np.int64)), total(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(b - a), pa.array(d - c)], [*names, "n_links", "n_best", "count_sum"])

    return fixed.mapInArrow(run, ddl)
