"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased (A-Z) words, each followed by a space byte, then one end byte.
Every byte is decomposed into eight binary decisions; each decision has a context tree over
the bytes before it, no deeper than ``DEPTH``.  Contexts of a word's first ``HEAD`` bytes reach
``TAIL`` bytes into the word before, those of later bytes back to the word's start.  At every node a
Krichevsky-Trofimov estimate is kept, and the prediction mixes the estimates of all
depths with the exact context-tree weights (Willems, Shtarkov and Tjalkens, 1995), which
depend only on the counts of zeros and ones in the training texts.

A text's code length is therefore a sum over units: the head of each word after the tail of
the word before, and the rest of each word.  The work is done in three layers of distinct
values: texts are written as blocks of word numbers with a dictionary of units each;
dictionaries meet in the vocabulary; the vocabulary's units are made of byte windows (context and symbol), which carry the tree.  Each layer is
reached by a shuffled join; only nodes of at most two context bytes (at most
65,536 x 255 of them, whatever the corpus) are gathered on the driver and broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded, crc_bucket, drop_table, limit_batches, materialize, parallelism, release

#: Bytes of context of the deepest nodes; a window (context and symbol) fills 64 bits.
DEPTH = 7
#: Bytes of a word whose contexts reach into the word before, and how far they reach there.
HEAD, TAIL = 3, 2
#: Text bytes of a block, and units of a vocabulary part: what one task holds at a time.
BLOCK_BYTES, PART_UNITS = 32 << 20, 400_000
#: Windows whose trees one task builds at a time (whole three-byte contexts).
TREE_WINDOWS = 1 << 19
#: The end of a text stands in dictionaries as a lone space, which no word can be.
END, HEAD_MARK = b" ", b"\t"
TERMINATOR, END_SYMBOL = 0x20, 0x0A
_LOG2, _LN10 = float(np.log(2)), float(np.log(10))


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) for whole n >= 0."""
    x = n + 0.5
    shift = np.where(x < 8, 8.0, 0.0)
    y = x + shift
    out = (y - 0.5) * np.log(y) - y + 0.918938533204672742 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    low = x < 8
    if low.any():
        z = x[low]
        out[low] -= np.log(z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6) * (z + 7))
    return out


def _lgamma_int(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1) for whole n >= 0, by duplication."""
    m = n + 1.0
    y = m + np.where(m < 8, 8.0, 0.0)
    out = (y - 0.5) * np.log(y) - y + 0.918938533204672742 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    low = m < 8
    if low.any():
        z = m[low]
        out[low] -= np.log(z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6) * (z + 7))
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma_half(zeros) + _lgamma_half(ones) - _lgamma_int(zeros + ones) - np.log(np.pi)


def head_unit(tail: bytes, head: bytes) -> bytes:
    """The unit of a word's head; its mark is a tab, which no word holds."""
    return HEAD_MARK + bytes([len(tail)]) + tail + head


def tail_of(word: bytes) -> bytes:
    return bytes([END_SYMBOL]) if word == END else word[-TAIL:]


def head_of(word: bytes) -> bytes:
    return bytes([END_SYMBOL]) if word == END else (word + bytes([TERMINATOR]))[:HEAD]


def unit_windows(units: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(window, unit index) of every byte that the units code: a word's bytes after its head,
    or a head's bytes.

    A window holds the symbol in its low byte and above it the bytes before, nearest first;
    a space stands before each word, and contexts are zero beyond their reach.
    """
    spelled, first = [], np.zeros(len(units), np.int64)
    for i, u in enumerate(units):
        if u[:1] == HEAD_MARK:
            first[i] = u[1] + 1
            spelled.append(u[2 : 2 + u[1]] + b" " + u[2 + u[1] :])
        else:
            first[i] = 1 + HEAD
            spelled.append(b" " + u + b" " if u != END else b"")
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
    symbols = np.frombuffer(b"".join(spelled), np.uint8)
    index = np.repeat(np.arange(len(spelled)), sizes)
    within = np.arange(len(symbols)) - (np.cumsum(sizes) - sizes)[index]
    coded = np.flatnonzero(within >= first[index])
    index, within = index[coded], within[coded]
    windows = symbols[coded].astype(np.uint64)
    for k in range(1, depth + 1):
        context = np.zeros(len(coded), np.uint64)
        has = np.flatnonzero(within >= k)
        context[has] = symbols[coded[has] - k]
        windows |= context << np.uint64(8 * k)
    return windows, index


def _prefix(symbols: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """The node of decision ``bit`` (0: highest) within a byte's tree, and the decision."""
    return np.uint64(1 << bit) | (symbols >> np.uint64(8 - bit)), (symbols >> np.uint64(7 - bit)) & np.uint64(1)


def _levels(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deep: int, shallow: int):
    """Nodes from depth ``deep`` up to ``shallow``: for each depth (keys, zeros, ones, log KT,
    log weighted, parent index).  A key holds context bytes above the low byte's prefix."""
    out, below = [], None
    for d in range(deep, shallow - 1, -1):
        if below is None:
            log_e = log_kt(zeros, ones)
            log_w = log_e
        else:
            mask = np.uint64(((1 << (8 * (d + 1))) - 1) & 0xFFFFFFFFFFFFFFFF)
            key, parent = np.unique(below[0] & mask, return_inverse=True)
            below[5] = parent
            zeros, ones = (np.bincount(parent, x, len(key)) for x in below[1:3])
            log_e = log_kt(zeros, ones)
            log_w = np.logaddexp(log_e, np.bincount(parent, below[4], len(key))) - _LOG2
        below = [key, zeros, ones, log_e, log_w, None]
        out.append(below)
    return out


def _share(zeros, ones, bit):
    return (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)


def deep_mix(windows: np.ndarray, counts: np.ndarray, depth: int, shallow: int) -> tuple[np.ndarray, list]:
    """Weighted predictions of the windows' decisions by nodes of depth ``shallow`` and
    deeper (one column for each bit), and the nodes of depth ``shallow`` as arrays
    (key, zeros, ones, log weighted) for each bit."""
    mixed, top = np.zeros((len(windows), 8)), []
    context = windows & np.uint64(0xFFFFFFFFFFFFFF00)
    for t in range(8):
        prefix, bit = _prefix(windows & np.uint64(0xFF), t)
        key, first = np.unique(context | prefix, return_inverse=True)
        zeros, ones = np.bincount(first, counts * (bit == 0), len(key)), np.bincount(first, counts * (bit == 1), len(key))
        levels = _levels(key, zeros, ones, depth, shallow)
        p = _share(zeros[first], ones[first], bit)
        at = first
        for child, node in zip(levels, levels[1:]):
            at = child[5][at]
            w = np.exp(node[3] - _LOG2 - node[4])[at]
            p = w * _share(node[1][at], node[2][at], bit) + (1 - w) * p
        mixed[:, t] = p
        k, z, o, _, lw, _ = levels[-1]
        top.append((k, z, o, lw))
    return mixed, top


class TopNodes:
    """Nodes of at most two context bytes: the last steps of the mixture."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        """Nodes of depth two with the sums of their children's log weighted probabilities."""
        order = np.argsort(key)
        key, zeros, ones, below = key[order], zeros[order], ones[order], below[order]
        self.levels = []
        for d in (2, 1, 0):
            log_e = log_kt(zeros, ones)
            log_w = np.logaddexp(log_e, below) - _LOG2
            self.levels.append((key, zeros, ones, np.exp(log_e - _LOG2 - log_w)))
            parents, parent = np.unique(key & np.uint64((1 << (8 * d)) - 1 if d else 0), return_inverse=True)
            if d:
                zeros, ones, below = (np.bincount(parent, x, len(parents)) for x in (zeros, ones, log_w))
                key = parents

    def log_probability(self, windows: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Natural log of the windows' probabilities, given the deeper predictions."""
        total = np.zeros(len(windows))
        for t in range(8):
            prefix, bit = _prefix(windows & np.uint64(0xFF), t)
            p = mixed[:, t]
            for (key, zeros, ones, weight), d in zip(self.levels, (2, 1, 0)):
                at = np.searchsorted(key, (windows & np.uint64(((1 << (8 * d)) - 1) << 8)) | prefix)
                w = weight[at]
                p = w * _share(zeros[at], ones[at], bit) + (1 - w) * p
            total += np.log(p)
        return total


def blocks(docs: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """Rows of three kinds: 0, a document's word numbers (``ids``); 1, a unit of a block's
    dictionary (``slot``, ``unit``) with its count ``n`` in the block's training texts; 2, for each block,
    the number ``n`` of its words, the tail and head numbers of each word (``ids``) and the tail
    and head number of each head unit, as one sorted number (``unit``).  Words have the first slots and head
    units the next ones.  The end of a text is a word too."""
    limit_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", (crc_bucket(F.col("doc_id"), modulus) == held_out).alias("held_out"))
    kind = dict(docs.dtypes)["doc_id"]
    out = f"kind int, block bigint, doc_id {kind}, held_out boolean, ids binary, slot int, unit binary, n bigint"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq, held = TaskContext.get().partitionId() << 24, []
        size, slots = 0, None

        def table(rows_out, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows_out, f.type)).cast(f.type) for f in arrow], schema=arrow)

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(slots)
            tails, heads = {}, {}
            tail = np.array([tails.setdefault(tail_of(w), len(tails)) for w in words], np.int32)
            head = np.array([heads.setdefault(head_of(w), len(heads)) for w in words], np.int32)
            tail_end = tails.setdefault(tail_of(END), len(tails))
            all_ids = np.concatenate([x for ids, _ in held for x in ids])
            ends = np.cumsum([len(x) for ids, _ in held for x in ids])
            learned = np.repeat(~np.concatenate([h for _, (_, h) in held]), np.diff(ends, prepend=0))
            counts = np.bincount(all_ids, learned, len(words)).astype(np.int64)
            before = np.concatenate([[tail_end], tail[all_ids[:-1]]])
            before[ends[:-1]] = tail_end
            parts = (slice(at, at + 1_000_000) for at in range(0, len(all_ids), 1_000_000))
            pairs, pair_counts = _summed((before[to].astype(np.int64) * len(heads) + head[all_ids[to]], learned[to]) for to in parts)
            for ids, (doc_ids, out) in held:
                n = len(ids)
                yield table(n, kind=pa.array(np.zeros(n, np.int32)), block=pa.array(np.full(n, seq)), doc_id=doc_ids, held_out=pa.array(out), ids=pa.array([x.tobytes() for x in ids], pa.binary()))
            tail_names, head_names = list(tails), list(heads)
            pair_tail, pair_head = np.divmod(pairs, len(heads))
            units = [head_unit(tail_names[a], head_names[b]) for a, b in zip(pair_tail.tolist(), pair_head.tolist())]
            shape = np.stack([tail, head]).astype(np.int32).tobytes()
            yield table(1, kind=pa.array([2]), block=pa.array([seq]), ids=pa.array([shape], pa.binary()), unit=pa.array([(pair_tail << 32 | pair_head).tobytes()], pa.binary()), n=pa.array([len(words)]))
            names, count = words + units, np.concatenate([counts, pair_counts])
            for at in range(0, len(names), 100_000):
                part = names[at : at + 100_000]
                n = len(part)
                yield table(n, kind=pa.array(np.ones(n, np.int32)), block=pa.array(np.full(n, seq)), slot=pa.array(np.arange(at, at + n, dtype=np.int32)), unit=pa.array(part, pa.binary()), n=pa.array(count[at : at + n]))

        for batch in bounded(batches):
            if slots is None:
                slots = defaultdict()
                slots.default_factory = slots.__len__
            ids = []
            for text in batch.column(1).to_pylist():
                words = text.encode().lower().split() if text else []
                words.append(END)
                ids.append(np.fromiter(map(slots.__getitem__, words), np.uint32, len(words)))
                size += len(text or "")
            held.append((ids, (batch.column(0), batch.column(2).to_numpy(zero_copy_only=False).astype(bool))))
            if size >= BLOCK_BYTES:
                yield from flush()
                seq, held, size, slots = seq + 1, [], 0, None
        if held:
            yield from flush()

    arrow = to_arrow_schema(_parse_datatype_string(out))
    return rows.mapInArrow(run, out)


def _summed(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights, over (keys, weights) that are made one part at a time."""
    keys, sums = [], []
    for key, weight in parts:
        distinct, where = np.unique(key, return_inverse=True)
        keys.append(distinct)
        sums.append(np.bincount(where, weight, len(distinct)).astype(np.int64))
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(where, np.concatenate(sums), len(distinct)).astype(np.int64)


def _window_counts(vocabulary: DataFrame) -> DataFrame:
    """``part, win, n`` of the vocabulary's windows, once for each part that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words, counts = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            def spelled() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for at in range(0, len(words), 100_000):
                    windows, index = unit_windows(words[at : at + 100_000])
                    yield windows, np.array(counts[at : at + 100_000], float)[index]

            if words:
                win, n = _summed(spelled())
                for at in range(0, len(win), 200_000):
                    w = win[at : at + 200_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), part, np.int32)), pa.array(w), pa.array(n[at : at + 200_000])], ["part", "win", "n"])
            words.clear(), counts.clear()

        for batch in batches:
            for p, w, c in zip(*(x.to_pylist() for x in batch.columns)):
                if p != part or len(words) >= PART_UNITS:
                    yield from flush()
                    part = p
                words.append(w), counts.append(c)
        yield from flush()

    return vocabulary.select("part", "unit", "c").mapInArrow(run, "part int, win bigint, n bigint")


def _dealt(counts: DataFrame) -> DataFrame:
    """``win, n, near`` with all windows of the same three bytes before the symbol in one task, in order."""
    near = F.shiftrightunsigned(F.col("win"), 8).bitwiseAND(F.lit(0xFFFFFF))
    parts = max(parallelism(counts.sparkSession), 1)
    return counts.withColumn("near", near).repartition(parts, "near").sortWithinPartitions("near").select("win", "n", "near")


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Windows, their deep predictions and the nodes of three context bytes, for whole groups at a time."""

    def grow(win: np.ndarray, n: np.ndarray):
        win = win.view(np.uint64)
        return win, *deep_mix(win, n.astype(float), DEPTH, 3)

    held, size = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= TREE_WINDOWS:
            win, n, near = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(near, near[-1]))
            if cut:
                yield grow(win[:cut], n[:cut])
            held, size = [[win[cut:], n[cut:], near[cut:]]], len(win) - cut
    if size:
        win, n, _ = (np.concatenate(x) for x in zip(*held))
        yield grow(win, n)


def top_nodes(counts: DataFrame) -> TopNodes:
    """Nodes of two context bytes and less, from all windows' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, top in _grown(batches):
            key = np.concatenate([k for k, *_ in top])
            two, where = np.unique(key & np.uint64(0xFFFFFF), return_inverse=True)
            sums = [np.bincount(where, np.concatenate([x[i] for x in top]), len(two)) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(two.view(np.int64)), *map(pa.array, sums)], ["node", "zeros", "ones", "below"])

    nodes = _dealt(counts).mapInArrow(run, "node bigint, zeros double, ones double, below double")
    # at most 65,536 x 255 rows, whatever the corpus
    table = nodes.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toArrow()
    return TopNodes(table.column("node").to_numpy().view(np.uint64), *(table.column(c).to_numpy() for c in ("zeros", "ones", "below")))


def window_logs(counts: DataFrame, top: TopNodes) -> DataFrame:
    """``win, log``: the log10 probability of each window's symbol after its context."""
    shared = counts.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for win, mixed, _ in _grown(batches):
            log = shared.value.log_probability(win, mixed) / _LN10
            for at in range(0, len(win), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(win[at : at + 200_000].view(np.int64)), pa.array(log[at : at + 200_000])], ["win", "log"])

    return _dealt(counts).mapInArrow(run, "win bigint, log double")


def score_documents(docs: DataFrame, modulus: int = 5, held_out: int = 1) -> DataFrame:
    """Score every whole text with the model of the rows whose crc32 bucket isn't ``held_out``.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes``:
    tokens with the end, those seen in training, training tokens, the smoothed unigram
    score, the log10 probability by context-tree weighting, and the coded bytes
    (``-score / log10(2) / n_bytes`` is the code length in bits a byte).

    NULL and empty texts have the end token alone.  NULL ids fall in the bucket of the empty
    string.  Repeated rows each give a row, and count each time in training.  With an
    empty table, or none to learn from, nothing fails: all estimates are then those of zero counts.
    """
    spark = docs.sparkSession
    stored = materialize(blocks(docs, modulus, held_out), "op3-blocks", ["kind"])
    texts = stored.where("kind <> 1").select("kind", "block", "doc_id", "held_out", "ids", "unit", "n")
    entries = stored.where("kind = 1").select("block", "slot", "unit", "n")
    parts = max(1, -(-entries.count() // (2 * PART_UNITS)))
    vocabulary = entries.groupBy("unit").agg(F.sum("n").alias("c")).withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(parts)).cast("int"))
    vocabulary = materialize(vocabulary.repartition(max(parts, spark.sparkContext.defaultParallelism), "part").sortWithinPartitions("part", "unit"), "op3-vocabulary")
    total, kinds = vocabulary.where("c > 0 and substring(unit, 1, 1) <> X'09'").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    windows = materialize(_window_counts(vocabulary), "op3-windows")
    counts = materialize(windows.groupBy("win").agg(F.sum("n").alias("n")), "op3-counts")
    logs = materialize(window_logs(counts, top_nodes(counts)), "op3-logs")
    drop_table(counts)
    needed = windows.select("part", "win").join(logs, "win")

    def spell(units: pa.Table, logs: pa.Table) -> pa.Table:
        names = units.column("unit").to_pylist()
        win, log = logs.column("win").to_numpy().view(np.uint64), logs.column("log").to_numpy()
        order = np.argsort(win)
        win, log = win[order], log[order]
        logs_of, sizes = [np.zeros(0)], [np.zeros(0, np.int32)]
        for at in range(0, len(names), 100_000):
            n = min(100_000, len(names) - at)
            windows, index = unit_windows(names[at : at + n])
            logs_of.append(np.bincount(index, log[np.searchsorted(win, windows)] if len(windows) else None, n).astype(float))
            sizes.append(np.bincount(index, minlength=n).astype(np.int32))
        return pa.table({"unit": units.column("unit"), "c": units.column("c"), "log": pa.array(np.concatenate(logs_of)), "size": pa.array(np.concatenate(sizes))})

    spelled = vocabulary.select("part", "unit", "c").groupBy("part").cogroup(needed.groupBy("part")).applyInArrow(spell, "unit binary, c bigint, log double, size int")
    spelled = materialize(spelled, "op3-units")
    for done in (windows, logs, vocabulary):
        drop_table(done)
    del windows, logs, vocabulary, needed, done
    release(spark)

    floor = float(np.log10(total + 0.5 * (kinds + 1)))
    kind = dict(docs.dtypes)["doc_id"]

    def add_up(texts: pa.Table, units: pa.Table) -> pa.Table:
        slot, count, logs, sizes = (units.column(c).to_numpy() for c in ("slot", "c", "log", "size"))
        order = np.argsort(slot)  # every slot of the block is there once
        count, logs, sizes = count[order], logs[order], sizes[order]
        kind = texts.column("kind").to_numpy()
        (at,) = np.flatnonzero(kind == 2)
        n_words = texts.column("n")[at].as_py()
        tails, heads = np.frombuffer(texts.column("ids")[at].as_py(), np.int32).reshape(2, -1).astype(np.int64)
        pairs = np.frombuffer(texts.column("unit")[at].as_py(), np.int64)
        base, known = np.log10(count[:n_words] + 0.5) - floor, count[:n_words] > 0
        texts = texts.filter(pa.array(kind == 0))
        rows = []
        for ids in texts.column("ids"):
            at = np.frombuffer(ids.as_buffer(), np.uint32)
            before = tails[np.concatenate([at[-1:], at[:-1]])]  # a text ends with the end, and begins after one
            pair = n_words + np.searchsorted(pairs, before << 32 | heads[at])
            rows.append((len(at), int(known[at].sum()), float(base[at].sum()), float(logs[at].sum() + logs[pair].sum()), int(sizes[at].sum() + sizes[pair].sum())))
        n_tokens, n_known, base_score, score, n_bytes = zip(*rows) if rows else [()] * 5
        return pa.table(
            {"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base_score": pa.array(base_score, pa.float64()), "score": pa.array(score, pa.float64()), "n_bytes": pa.array(n_bytes, pa.int64())}
        )

    known = entries.select("block", "slot", "unit").join(spelled, "unit").select(F.col("block").alias("of_block"), "slot", "c", "log", "size")
    scored = texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(add_up, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, n_bytes bigint")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score", "n_bytes")
