"""The boundary to an external scorer, with a deterministic one for offline use."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_SPACE = " \t\n\r\f"
#: Bytes of text that are scored at once (one text at least), and rows of an answer's batch.
PIECE_BYTES, ANSWER_ROWS = 1 << 20, 4096
#: Bytes of text that Spark gathers for one batch.
BATCH_BYTES = 4 << 20


class Scorer(Protocol):
    """Scores a batch of texts: for each, a list of (attribute, statement, score or None)."""

    def __call__(self, texts: list[str]) -> list[list[tuple[str, str, float | None]]]: ...


class RuleScorer:
    """Scores every sentence (up to a full stop) by its length and its variety of words."""

    def __call__(self, texts: list[str]) -> list[list[tuple[str, str, float | None]]]:
        out = []
        for text in texts:
            found: list[tuple[str, str, float | None]] = []
            for sentence in (text or "").split("."):
                sentence = sentence.strip(_SPACE)
                words = re.findall(f"[^{_SPACE}]+", sentence.lower())
                if words:
                    variety = round(len(set(words)) / len(words), 6)
                    found += [("focus", sentence, round(min(1.0, len(words) / 40), 6)), ("variety", sentence, variety if len(words) > 2 else None)]
            out.append(found)
        return out


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch ``(id, text)`` in slices of at most ``most`` bytes of text, or of one row."""
    start = total = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)


def score(windows: DataFrame, scorer: Scorer, attempts: int = 3) -> DataFrame:
    """``window_id, attribute, idx, statement, score`` of rows ``window_id, text``.

    Scores outside 0 to 1 are clamped, missing ones stay NULL.  The scorer gets texts in batches of
    bounded bytes, whatever their lengths; a batch that fails is tried
    again up to ``attempts`` times; a scorer that answers with another number of rows is refused.
    """
    kind, spark = dict(windows.dtypes)["window_id"], windows.sparkSession
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)

    def answered(texts: list[str]) -> list[list[tuple[str, str, float | None]]]:
        for attempt in range(attempts):
            try:
                answers = scorer(texts)
                break
            except OSError:
                if attempt + 1 == attempts:
                    raise
        if len(answers) != len(texts):
            raise ValueError("the scorer's answers don't match its questions")
        return answers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, PIECE_BYTES):
                answers = answered(piece.column(1).to_pylist())
                rows = ((i, a, k, s, None if v is None else min(1.0, max(0.0, float(v)))) for i, found in zip(piece.column(0).to_pylist(), answers) for k, (a, s, v) in enumerate(found))
                while part := list(islice(rows, ANSWER_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (batch.column(0).type, pa.string(), pa.int32(), pa.string(), pa.float64()))], ["window_id", "attribute", "idx", "statement", "score"])

    return windows.select("window_id", "text").mapInArrow(run, f"window_id {kind}, attribute string, idx int, statement string, score double")
