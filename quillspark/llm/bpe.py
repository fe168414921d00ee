"""BPE encoding and decoding by tree concatenation.

A text is cut at ASCII white space, which no token of the supported tokenizers spans.
Short pieces are encoded once each by the tokenizers library and kept in a bounded
cache.  A long piece that white space does not cut is normalised and pre-tokenised by the
library; every unsplit run above ``leaf`` symbols is encoded by tree concatenation: its
leaves are encoded in parallel in one batch, then neighbours are joined pairwise up a binary tree.  At
each join a window around the seam is encoded anew and doubled until its first token equals the left side's token there
and its last token equals the right side's.  Adjacent tokens that came out of one encoding are compatible, and a sequence whose neighbours are
all compatible is the encoding of the whole, so the result is exactly the library's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import bounded

#: Pieces of up to this many characters go to the library whole.
LEAF = 256
#: Entries of the piece cache of one Python worker; it starts anew beyond that.
CACHE_PIECES = 600_000
#: Text bytes that are cut into pieces at a time.
PART_BYTES = 2 << 20
_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Fixed value: a pre-tokenizer's pattern (as JSON) that keeps letters, digits and other signs apart.
_PATTERN = r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters below this are composed, and lower-case alike everywhere.
_BEYOND_LATIN = "\u0180"


def _pieces(text: str) -> list[str]:
    """Cut at white space; str.split also cuts at the four separators that aren't white space."""
    return [p for p in _SPACE.split(text) if p] if _SEPARATORS.search(text) else text.split()


class TreeEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does."""

    def __init__(self, tokenizer_json: str, leaf: int = LEAF):
        from tokenizers import Tokenizer, models

        self.leaf = leaf
        spec = json.loads(tokenizer_json)
        spec["truncation"] = spec["padding"] = None
        self.library = Tokenizer.from_str(json.dumps(spec))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix"):
            raise ValueError("tree concatenation needs a BPE model without a prefix for inner symbols")
        suffix = model.get("end_of_word_suffix") or None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = len(suffix) if suffix else 0
        self.parts = model["vocab"], merges
        self.final = Tokenizer(models.BPE(*self.parts, end_of_word_suffix=suffix))
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.text_of = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.ends = {i for t, i in model["vocab"].items() if suffix and t.endswith(suffix)}

    @cached_property
    def inner(self):
        """Encodes runs that the end of a word doesn't follow; made for the first long run."""
        from tokenizers import Tokenizer, models

        return Tokenizer(models.BPE(*self.parts))

    def width(self, token: int) -> int:
        """Symbols that a token covers."""
        return len(self.text_of[token]) - (self.suffix if token in self.ends else 0)

    def run(self, symbols: str) -> list[int]:
        """Ids of one unsplit run of byte-level symbols."""
        n = len(symbols)
        if n <= self.leaf:
            return self.final.encode(symbols, add_special_tokens=False).ids
        cuts = [*range(0, n - self.leaf // 2, self.leaf), n]
        leaves = [symbols[a:b] for a, b in zip(cuts, cuts[1:])]
        parts = [e.ids for e in self.inner.encode_batch(leaves[:-1], add_special_tokens=False)]
        parts.append(self.final.encode(leaves[-1], add_special_tokens=False).ids)
        while len(parts) > 1:
            spans = [*cuts[::2], n] if cuts[-1] != cuts[::2][-1] else cuts[::2]
            parts = [
                self.join(symbols, cuts[2 * i + 1], parts[2 * i], parts[2 * i + 1], cuts[2 * i], cuts[2 * i + 2], n) if 2 * i + 1 < len(parts) else parts[2 * i]
                for i in range((len(parts) + 1) // 2)
            ]
            cuts = spans
        return parts[0]

    def join(self, symbols: str, seam: int, left: list[int], right: list[int], low: int, high: int, n: int) -> list[int]:
        """Ids of symbols[low:high] from those of the two sides of ``seam``."""
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            start, stop = seam - sum(map(self.width, a)), seam + sum(map(self.width, b))
            coder = self.final if stop == n else self.inner
            window = coder.encode(symbols[start:stop], add_special_tokens=False).ids
            if (k >= len(left) or window[0] == a[0]) and (k >= len(right) or window[-1] == b[-1]):
                return left[:-k] + window + right[k:]
            k *= 2

    def long_piece(self, piece: str) -> list[int]:
        """Ids of a piece without white space that is too long to go to the library whole."""
        out: list[int] = []
        for i, part in enumerate(self.added.split(piece) if self.added else [piece]):
            if i % 2:
                out.append(self.library.token_to_id(part))
            elif part:
                normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                runs = self.library.pre_tokenizer.pre_tokenize_str(normal) if self.library.pre_tokenizer else [(normal, None)]
                for symbols, _ in runs:
                    out += self.run(symbols)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids, skip_special_tokens=False)


class _Slots(dict):
    """Numbers of pieces in the order of their first sight; new ones gather in ``fresh``."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        self[piece] = slot = len(self)
        return slot


def _ragged(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[starts[0] : starts[0] + sizes[0]] and so on, one after another."""
    ends = np.cumsum(sizes)
    shift = np.repeat(starts - (ends - sizes), sizes)
    return pool[shift + np.arange(len(shift))]


class CachedEncoder:
    """Encodes whole texts piece by piece; the ids of known pieces stand in one array.

    All is forgotten before a call once more than ``most`` pieces are known.
    """

    def __init__(self, tokenizer_json: str, most: int = CACHE_PIECES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tree, self.most = TreeEncoder(tokenizer_json), most
        #: Without a decoder the library puts one space between tokens.
        self.spaced = json.loads(tokenizer_json).get("decoder") is None
        self.names = [self.tree.text_of.get(i, "") for i in range(1 + max(self.tree.text_of))]
        #: Whether lower-case Latin words pass the normalizer and the pre-tokenizer unchanged, apart from trailing stops and commas.
        self.latin = _PATTERN in tokenizer_json and '"Lowercase"' in tokenizer_json and bool(self.tree.suffix)
        self.plain = Tokenizer(self.tree.final.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.is_end = np.zeros(len(self.names), bool)
        self.is_end[list(self.tree.ends)] = True
        self.forget()

    def forget(self) -> None:
        self.slots = _Slots()
        self.pool = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def lowered(self, text: str) -> str:
        """Lower case at once where the normalizer would do the same to every character."""
        if not self.latin or "<" in text:
            return text
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return text.lower()

    def core(self, piece: str) -> tuple[str, str]:
        """A piece as two parts that can be encoded apart; the second may be empty."""
        if not self.latin or "<" in piece or not (piece.isascii() or max(piece) < _BEYOND_LATIN):
            return piece, ""
        lowered = piece if piece.islower() else piece.lower()
        if lowered.isalpha():
            return lowered, ""
        stem = lowered.rstrip(".,")
        return (stem, lowered[len(stem) :]) if stem and stem[-1].isalnum() else (lowered, "")

    def learn(self, fresh: list[str]) -> None:
        """Store the ids of new pieces, which have the next slots in order."""
        known = len(self.starts)
        parts = list(map(self.core, fresh))
        local = _Slots()  # distinct parts; the first is the empty one
        order = list(map(local.__getitem__, ["", *(x for pair in parts for x in pair)]))[1:]
        starts, sizes, missing = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64), []
        for i, x in enumerate(local.fresh):
            slot = self.slots.get(x, known)
            if slot < known:
                starts[i], sizes[i] = self.starts[slot], self.sizes[slot]
            elif x:
                missing.append(i)
        base = self.used
        for places, ids, ends in self.encode_pieces([local.fresh[i] for i in missing], np.array(missing, np.int64)):
            starts[places], sizes[places] = self.used + np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
            self.append(ids)
        pairs = np.array(order, np.int64)
        ids = _ragged(self.pool, starts[pairs], sizes[pairs])
        new_sizes = sizes[pairs].reshape(-1, 2).sum(1)
        self.used = base  # parts that aren't pieces needn't stay
        self.starts = np.concatenate([self.starts, base + np.cumsum(new_sizes) - new_sizes])
        self.sizes = np.concatenate([self.sizes, new_sizes])
        self.append(ids)

    def append(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode_pieces(self, pieces: list[str], places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, ids, ends) of groups of pieces, by the library."""
        leaf = self.tree.leaf
        easy = np.array([self.latin and len(p) <= leaf and p.isalpha() and (p.isascii() or max(p) < _BEYOND_LATIN) and p.islower() for p in pieces], bool)
        words, at = [p for p, e in zip(pieces, easy) if e], places[easy]
        for k in range(0, len(words), 8_000):  # one call for many words, which are told apart by their end symbols
            ids = np.array(self.plain.encode_batch_fast([" ".join(words[k : k + 8_000])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(words[k : k + 8_000]):
                raise AssertionError("words and their ids don't match")
            yield at[k : k + 8_000], ids, ends
        rest, at = [p for p, e in zip(pieces, easy) if not e], places[~easy]
        for k in range(0, len(rest), 4_000):
            part = rest[k : k + 4_000]
            short = iter(self.tree.library.encode_batch_fast([p for p in part if len(p) <= leaf], add_special_tokens=False))
            found = [next(short).ids if len(p) <= leaf else self.tree.long_piece(p) for p in part]
            yield at[k : k + 4_000], np.array([i for x in found for i in x], np.uint32), np.cumsum([len(x) for x in found])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.slots) > self.most:
            self.forget()
        slot = self.slots.__getitem__
        found = [list(map(slot, _pieces(self.lowered(t)))) if t else [] for t in texts]
        if self.slots.fresh:
            fresh, self.slots.fresh = self.slots.fresh, []
            self.learn(fresh)
        at = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
        sizes = self.sizes[at]
        ids = _ragged(self.pool, self.starts[at], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(list(map(len, found)))]
        return np.split(ids, ends[:-1]) if found else []

    def decode(self, ids: np.ndarray) -> str:
        """The library's decoding, with special tokens kept."""
        return " ".join(map(self.names.__getitem__, ids.tolist())) if self.spaced else self.tree.decode(ids.tolist())


@cache
def worker_encoder(path: str) -> CachedEncoder:
    with open(path, encoding="utf-8") as f:
        return CachedEncoder(f.read())


def encode_documents(docs: DataFrame, tokenizer_path: str, decode: bool = True) -> DataFrame:
    """``doc_id, ids, n_tokens[, decoded]`` of every row: ids are little-endian unsigned
    32-bit integers in one binary value; ``decoded`` is the library's decoding of them
    with special tokens kept.

    NULL and empty texts give no ids and an empty decoding.  Repeated rows each give a
    row, NULL ids stay, an empty table gives an empty table, and other columns are ignored.
    ``tokenizer_path`` is read by each Python worker, from the installed vocabulary files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_encoder(tokenizer_path)
        names = ["doc_id", "ids", "n_tokens"] + ["decoded"] * decode
        for batch in bounded(batches, most=PART_BYTES):
            ids = coder.encode(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(list(map(len, ids)), pa.int64())]
            if decode:
                columns.append(pa.array([coder.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)
        coder.forget()  # other stages may run in this worker next

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens bigint" + ", decoded string" * decode)
