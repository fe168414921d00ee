import hashlib
import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.llm import paragraph_sketch as ps
from quillspark.llm import queries
from tests.conftest import SF
from tests.llm.helpers import docs_of


def pieces(text):
    parts = re.split(r"(?<=[.!?,;:])[ \t\n\x0b\f\r]+|\n", text[: ps.HEAD]) + re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n", text[ps.HEAD :])
    return Counter(p[i : i + ps.LONGEST] for p in parts for i in range(0, len(p), ps.LONGEST) if p[i : i + ps.LONGEST].strip(" "))


def like(a, b):
    a, b = pieces(a), pieces(b)
    both = sum((a & b).values())
    union = sum(a.values()) + sum(b.values()) - both
    return both / union if union else 1.0


def expected(rows):
    order = sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t in rows), key=lambda r: (r[0], r[1].encode()), reverse=True)
    out = []
    for k, (_, text, i) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        out.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), round(like(text, edited), 9), round(like(text, after), 9)))
    return sorted(out)


def found(df):
    return sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect())


@pytest.mark.parametrize("n", [1, 2, 40])
def test_against_plain_sets(spark, n):
    rng = random.Random(n)
    line = lambda: " ".join(rng.choices("ab cd é ef gh 😀 ij".split(), k=rng.randint(1, 6))) + rng.choice([".", "", "!"])
    rows = [(i * 7, rng.choice(["\n", " ", "\n\n"]).join(line() for _ in range(rng.choice([0, 1, 5, 30, 400])))) for i in range(n)]
    assert found(ps.fingerprint_versions(docs_of(spark, rows))) == expected(rows)


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(5, "a b c\nd"), (5, "a b c\nd"), (5, None), (None, "x y"), (3, ""), (2, "q " * 30)]
    got = ps.fingerprint_versions(docs_of(spark, rows))
    assert found(got) == expected(rows)
    by_text = {}
    for r, t in zip(sorted(got.collect(), key=lambda r: r["n_chars"]), sorted((t or "" for _, t in rows), key=len)):
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert ps.fingerprint_versions(docs_of(spark, [])).count() == 0


def test_peeling_recovers_the_digests(spark):
    rng = random.Random(1)
    for n in (0, 1, 5, 9, 300):
        a, b = [rng.getrandbits(63) for _ in range(n + 3)], [rng.getrandbits(63) for _ in range(n)]
        shared = [rng.getrandbits(63) for _ in range(50)]
        df = spark.createDataFrame([(sorted(a + shared), sorted(b + shared))], "a array<bigint>, b array<bigint>")
        df = df.withColumns({"ca": ps.cells(F.col("a"), F.lit(0)), "cb": ps.cells(F.col("b"), F.lit(0))})
        state = df.select(ps.peel(ps.subtract(F.col("ca"), F.col("cb")), F.lit(0)).alias("s")).select("s.found", ps.failed(F.col("s")).alias("failed")).first()
        if n <= 5:
            assert not state["failed"] and {(r["k"], r["s"]) for r in state["found"]} == {(x, 1) for x in a} | {(x, -1) for x in b}
        out = df.select(ps.differing(*map(F.col, ("a", "b", "ca", "cb"))).alias("out")).first()["out"]
        assert (out["n"], out["left"]) == (2 * n + 3, 0)


def test_query_against_plain_sets(spark):
    texts = list(pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"]).itertuples(index=False, name=None))
    got = queries.op4_paragraph_sketch(spark, SF)
    assert found(got) == expected(texts)


@pytest.mark.parametrize("length", [395, 405, 2990, 3193])
def test_likeness_does_not_jump_at_any_length(spark, length):
    rng = random.Random(length)
    text = ""
    while len(text) < length:
        text += " ".join(rng.choices([f"w{i}" for i in range(300)], k=rng.randint(3, 12))) + rng.choice([". ", ", ", "\n"])
    rows = [(9, text[:length]), (8, "short one"), (7, text[:length]), (6, text[: length * 9 // 10])]
    got = {r["doc_id"]: r for r in ps.fingerprint_versions(docs_of(spark, rows)).collect()}
    assert got[9]["near_edited"] >= 0.5
    assert got[7]["near_next"] >= 0.7


def test_long_texts_and_repeats(spark):
    lines = [f"line {i % 30_000} of the text" for i in range(100_000)]
    text = "\n".join(lines)
    rows = [(3, text), (2, "\n".join(lines[:90_000])), (1, "one piece " * 3000), (0, "a," * 70_000)]
    got = ps.fingerprint_versions(docs_of(spark, rows))
    assert found(got) == expected(rows)
    assert got.agg(F.max(F.length("fingerprint"))).first()[0] < 600


def test_crowded_ids_are_dealt_by_text(spark):
    rng = random.Random(8)
    rows = [(7 if i % 3 else i, f"{rng.random()} text. second {i}") for i in range(600)] + [(None, f"{i} nothing") for i in range(300)]
    df = docs_of(spark, rows)
    assert found(ps.fingerprint_versions(df)) == expected(rows)
    marked = df.select(F.coalesce("doc_id", F.lit(ps._FIRST)).alias("ord"), ps._begin(F.col("text")).alias("begin"))
    bounds = ps._bounds(marked, 16)
    sizes = marked.groupBy(ps._range(bounds).alias("b")).count().collect()
    assert max(r["count"] for r in sizes) < 150


def test_columns_of_clashing_names(spark):
    df = docs_of(spark, [(1, "a b. c"), (2, "d")]).withColumns({"ord": F.lit(1), "b": F.lit("x"), "next_text": F.lit("y"), "begin": F.lit(0), "a": F.lit(2)})
    assert found(ps.fingerprint_versions(df)) == expected([(1, "a b. c"), (2, "d")])
