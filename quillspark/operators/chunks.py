"""Packing that may divide an item: paragraphs into pieces of a bounded size, in one pass.

What is held is the open piece and the item at hand, whatever a text's or a group's length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def chunk_paragraphs(paragraphs: Iterable[str], size: int) -> Iterator[str]:
    """Pieces of at most ``size`` characters of paragraphs joined by line feeds.

    A paragraph that doesn't fit closes the open piece and begins the next; a piece that is
    then still too long is cut at ``size`` and its remainder stays open.  Empty paragraphs
    are kept inside a piece and don't begin one.  A blank remainder at the end is dropped.
    """
    if size < 1:
        raise ValueError("a piece has a character at least")
    parts: list[str] = []
    n = 0
    for p in paragraphs:
        if n and n + len(p) + 1 > size:
            yield "\n".join(parts)
            parts, n = [], 0
        if n:
            n += 1 + len(p)
            parts.append(p)
        else:
            parts, n = [p], len(p)
        if n > size:  # then p is all there is, since what didn't fit has closed the piece
            cut = (n - 1) // size * size
            for at in range(0, cut, size):
                yield p[at : at + size]
            parts, n = [p[cut:]], n - cut
    last = "\n".join(parts)
    if last.strip():
        yield last


def paragraph_chunks(texts: DataFrame, id_: str, text: str, size: int) -> DataFrame:
    """``id_, chunk, text``: the pieces of each text, numbered from 0.

    NULL and blank texts give none; repeated rows each give their pieces.
    """
    kind = dict(texts.dtypes)[id_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                pieces = list(chunk_paragraphs((value.as_py() or "").split("\n"), size))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(pieces), pa.int64())), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.string())], [id_, "chunk", "text"])

    return texts.select(id_, text).mapInArrow(run, f"`{id_}` {kind}, chunk int, text string")


def divide(items: DataFrame, keys: list[str], order: str, size: str, limit: int) -> DataFrame:
    """``keys, order, window, start, length``: items of a group packed into windows of at most
    ``limit``, where an item larger than that is divided.

    An item that doesn't fit closes the open window; of a larger one each full ``limit`` is
    a window and the remainder stays open for the next items.  A row is a part of an item:
    where it begins within the item, and how much of it the window has.  Items of no or NULL
    size are in the open window with a length of 0.  Rows are sorted by key within their
    tasks and pass by one at a time; a group's rows are never held together.
    """
    kinds = dict(items.dtypes)
    names = [*keys, order]
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", window bigint, start bigint, length bigint"
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, window, filled = None, 0, 0
        for batch in batches:
            at, out = [], ([], [], [])
            columns = [c.to_pylist() for c in batch.columns]
            for i, (key, n) in enumerate(zip(zip(*columns[:n_keys]) if n_keys else [()] * batch.num_rows, columns[-1])):
                if key != group:
                    group, window, filled = key, 0, 0
                n, done = max(n or 0, 0), 0
                if filled and filled + n > limit:
                    window, filled = window + 1, 0
                while True:
                    take = min(n - done, limit)
                    at.append(i)
                    for c, v in zip(out, (window, done, take)):
                        c.append(v)
                    done, filled = done + take, filled + take
                    if done >= n:
                        break
                    window, filled = window + 1, 0
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(rows) for j in range(n_keys + 1)), *(pa.array(c, pa.int64()) for c in out)], [*names, "window", "start", "length"])

    dealt = items.repartition(*keys) if keys else items.repartition(1)
    return dealt.select(*names, size).sortWithinPartitions(*names).mapInArrow(run, ddl)
