"""Which entities a text mentions: one pass over each text with an Aho-Corasick automaton of all names.

The names go to the tasks as a broadcast of at most ``BLOCK_CHARS`` characters, which is
checked before; a larger roster is dealt over blocks by entity, and each block passes over
the texts once.  All names of an entity are in one block, so "only where the full name is
missing" is settled where the text is read, and nothing is shuffled but the hits.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of names in one automaton; a node a character takes up to some 100 bytes.
BLOCK_CHARS = 1 << 20
#: How a hit was made.
NAME, SURNAME = "name", "surname"


def fold(text: str | None) -> str:
    """Lower case without accents: compatibility decomposition, ASCII characters only."""
    return unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()


def folded_text(text: Column) -> Column:
    """``fold`` of a column; for names, since texts are folded where they are searched."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fold(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def at_word_edges(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] begins and ends at word boundaries, as ``\\b`` has them."""
    before = start > 0 and _is_word(text[start - 1])
    after = end < len(text) and _is_word(text[end])
    return before != _is_word(text[start]) and after != _is_word(text[end - 1])


def automaton(names: list[tuple[int, str, bool]]):
    """Automaton of (entity's place, name, whether it counts at word edges only)."""
    import ahocorasick

    found: dict[str, list[tuple[int, bool]]] = {}
    for place, name, edges in names:
        found.setdefault(name, []).append((place, edges))
    machine = ahocorasick.Automaton()
    for name, owners in found.items():
        machine.add_word(name, (len(name), owners))
    machine.make_automaton()
    return machine


def mentioned(machine, texts: list[str]) -> dict[int, str]:
    """Entities' places in any of ``texts``: by name, else by surname (which only the first is searched for)."""
    out: dict[int, str] = {}
    for k, text in enumerate(texts):
        for last, (n, owners) in machine.iter(text):
            edges = None
            for place, bound in owners:
                if not bound:
                    out[place] = NAME
                elif k == 0 and place not in out:
                    if edges is None:
                        edges = at_word_edges(text, last + 1 - n, last + 1)
                    if edges:
                        out[place] = SURNAME
    return out


def find_mentions(texts: DataFrame, id_: str, columns: list[str], names: DataFrame, entity: str, name: str, surname: str | None = None, folded: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``id_, entity, via``: the entities that each text mentions.

    A row of ``names`` has an entity and one of its names; where the boolean column
    ``surname`` is true the name counts at word boundaries only, in the first of ``columns``
    only, and only if no full name of the entity is in any of them (``via`` is then
    ``surname``).  Full names count anywhere.  ``folded`` compares without case and accents.
    NULL and empty texts mention nobody, NULL and empty names are nobody's; repeated rows of
    texts each give their rows.  Texts are read whole.
    """
    bound = F.coalesce(F.col(surname), F.lit(False)) if surname else F.lit(False)
    known = names.select(F.col(entity).alias("entity"), F.col(name).alias("name"), bound.alias("edges")).where("name <> '' and entity is not null").distinct()
    chars = known.agg(F.sum(F.length("name"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    kinds, spark = dict(texts.dtypes) | {"entity": dict(known.dtypes)["entity"]}, texts.sparkSession
    found = [spark.createDataFrame([], f"i {kinds[id_]}, e {kinds['entity']}, via string")]
    given = texts.select(F.col(f"`{id_}`").alias("i"), *(F.col(f"`{c}`") for c in columns))
    for k in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("entity"), F.lit(blocks)) == k).collect()  # about block_chars in all
        places = {e: i for i, e in enumerate(dict.fromkeys(r["entity"] for r in rows))}
        own = [(places[r["entity"]], fold(r["name"]) if folded else r["name"], r["edges"]) for r in rows]
        entities = spark.createDataFrame([(i, e) for e, i in places.items()], f"p int, e {kinds['entity']}")  # no more than names
        hits = given.mapInArrow(_pass(spark, [x for x in own if x[1]], folded), f"i {kinds[id_]}, p int, via string")
        found.append(hits.join(F.broadcast(entities), "p").select("i", "e", "via"))
    return reduce(DataFrame.unionByName, found).toDF(id_, entity, "via")


def _pass(spark: SparkSession, names: list[tuple[int, str, bool]], folded: bool):
    sent = spark.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(sent.value) if sent.value else None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[1:]]
            at, places, via = [], [], []
            for i, texts in enumerate(zip(*columns)):
                hits = mentioned(machine, [fold(t) if folded else t or "" for t in texts]) if machine else {}
                at += [i] * len(hits)
                places += hits
                via += hits.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(places, pa.int32()), pa.array(via, pa.string())], ["i", "p", "via"])

    return run
