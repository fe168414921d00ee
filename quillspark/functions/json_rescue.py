"""Arrays of JSON in replies that hold more than JSON: prose, fences, cut-off ends."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE, CUT = "whole", "cut"
#: A bracket that JSON may go on from.
_BEGIN = re.compile(r'\[\s*(?:[\[{"\d\]-]|true|false|null|$)')


def _spans(text: str) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """Balanced ``[...]`` in the order of their ends, and the outermost one that isn't closed, up to
    the end of its last whole element.

    One pass: brackets in strings don't count, a backslash in a string hides the next character, and
    outside of all brackets a quotation mark is prose, as is a bracket that no value follows.
    """
    found, open_ = [], []  # open_: (place, bracket, end of the last whole element or the place itself)
    quoted = hidden = False
    for i, c in enumerate(text):
        if hidden:
            hidden = False
        elif quoted:
            hidden, quoted = c == "\\", c != '"'
        elif c in "[{":
            if open_ or c == "[" and _BEGIN.match(text, i):
                open_.append([i, c, i])
        elif not open_:
            continue
        elif c == '"':
            quoted = True
        elif c == ",":
            open_[-1][2] = i
        elif c in "]}":
            start, opened, _ = open_.pop()
            if (opened == "[") != (c == "]"):
                open_.clear()  # crossed brackets are prose
                continue
            if opened == "[":
                found.append((start, i + 1))
            if open_:
                open_[-1][2] = i + 1
    return found, (open_[0][0], open_[0][2]) if open_ else None


def _list(text: str) -> list | None:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, list) else None


def rescue(text: str | None) -> tuple[str | None, str | None]:
    """(array as text, state): the first outermost array that parses, objects before others.

    Where none does and the text ends inside an array, that array up to its last whole
    element, with the state ``cut``.  (None, None) is a failure, unlike an empty array.
    """
    if not text or "[" not in text:
        return None, None
    found, rest = _spans(text)
    best, end = None, -1
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):  # the outer before the inner
        if a < end:
            continue
        if (value := _list(text[a:b])) is not None:
            end = b
            if value and isinstance(value[0], dict):
                return text[a:b], WHOLE
            best = best or text[a:b]
    if rest and (value := _list(text[rest[0] : rest[1]].rstrip(",") + "]" if rest[1] > rest[0] else "")) and (best is None or isinstance(value[0], dict)):
        return text[rest[0] : rest[1]] + "]", CUT
    return (best, WHOLE) if best is not None else (None, None)


def rescued(text: Column) -> Column:
    """struct<json: string, state: string> of ``rescue``; NULLs where nothing parses."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            found = [rescue(x) for x in array.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["json", "state"])

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<json:string,state:string>")(text)
