"""Questions to an outside judge whose answers echo the questions' ids.

The judge may answer in another order, leave questions out, answer twice, invent ids or say
what isn't in its vocabulary, and may wrap its array of answers in prose.  Answers are matched by
id; only what is still open of a batch is asked again, and what stays open is told as such.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.functions.json_rescue import rescue

ANSWERED, UNANSWERED, UNMATCHED = "answered", "unanswered", "unmatched"


class Judge(Protocol):
    """Answers questions (id, text) with text that holds an array of objects with ``id``, ``verdict``
    and ``reason``; ``again`` is how often the batch was asked before."""

    def __call__(self, questions: list[tuple[str, str]], again: int) -> str: ...


def batches_of(questions: Sequence[tuple[str, str]], most: int, most_chars: int) -> Iterator[list[tuple[str, str]]]:
    """Runs of at most ``most`` questions and ``most_chars`` characters, a longer one by itself."""
    batch, chars = [], 0
    for q in questions:
        if batch and (len(batch) >= most or chars + len(q[1]) > most_chars):
            yield batch
            batch, chars = [], 0
        batch.append(q)
        chars += len(q[1])
    if batch:
        yield batch


def settle(questions: list[tuple[str, str]], judge: Judge, vocabulary: frozenset[str] | None, attempts: int) -> tuple[dict[str, list], list[str]]:
    """([verdict, reason, asks, refused, doubled] of each id, ids that nobody asked about) of one batch."""
    out = {i: [None, None, 0, 0, 0] for i, _ in questions}
    strays: list[str] = []
    for again in range(attempts):
        left = [q for q in questions if out[q[0]][0] is None]
        if not left:
            break
        for i, _ in left:
            out[i][2] += 1
        try:
            reply = judge(left, again)
        except OSError:
            continue  # the batch failed; what it had stays
        answers = json.loads(rescue(reply)[0] or "[]")
        for answer in answers:
            i = str(answer.get("id")) if isinstance(answer, dict) else None
            if i not in out:
                strays.append(str(i))
                continue
            verdict = str(answer.get("verdict") or "").strip().lower()
            if not verdict or vocabulary is not None and verdict not in vocabulary:
                out[i][3] += 1
            elif out[i][0] is None:
                out[i][:2] = verdict, str(answer.get("reason") or "")
            else:
                out[i][4] += 1  # the first answer stays
    return out, strays


def ask(items: DataFrame, id_: str, text: str, judge: Judge, vocabulary: Sequence[str] | None = None, attempts: int = 3, most: int = 20, most_chars: int = 20_000) -> DataFrame:
    """``id_, verdict, reason, asks, refused, doubled, state`` of every item, and a row of state
    ``unmatched`` (NULL ``id_``, the id as ``reason``) for each answer to nobody's question.

    ``refused`` counts answers outside ``vocabulary`` (compared in lower case) or empty, ``doubled``
    those behind the first.  An item without an answer after ``attempts`` is ``unanswered``; a
    batch that fails has no bearing on others.  NULL texts are asked as empty; items of NULL
    id can't be echoed and are unanswered unasked; rows of one id in a batch share its answer.
    """
    kind = dict(items.dtypes)[id_]
    words = frozenset(v.lower() for v in vocabulary) if vocabulary is not None else None
    names = [id_, "verdict", "reason", "asks", "refused", "doubled", "state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            questions = {str(i): t or "" for i, t in zip(ids, batch.column(1).to_pylist()) if i is not None}
            found, strays = {}, []
            for part in batches_of(list(questions.items()), most, most_chars):
                own, lost = settle(part, judge, words, attempts)
                found |= own
                strays += lost
            rows = [(i, *f, ANSWERED if f[0] is not None else UNANSWERED) for i in ids for f in [found.get(str(i)) if i is not None else [None, None, 0, 0, 0]]]
            rows += [(None, None, s, 0, 0, 0, UNMATCHED) for s in strays]
            types = [batch.column(0).type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names)

    return items.select(id_, text).mapInArrow(run, f"`{id_}` {kind}, verdict string, reason string, asks int, refused int, doubled int, state string")
