import random
import re
import unicodedata

import pytest

from quillspark.operators import chunks, mentions


def plain_fold(s):
    return unicodedata.normalize("NFKD", s or "").encode("ascii", "ignore").decode().lower()


def plain_mentions(texts, names):
    out = set()
    for i, text, author in texts:
        t, a = plain_fold(text), plain_fold(author)
        for entity in {e for e, _, _ in names}:
            own = [(plain_fold(n), s) for e, n, s in names if e == entity and n]
            if any(n and (n in t or n in a) for n, s in own if not s):
                out.add((i, entity, "name"))
            elif any(n and re.search(r"\b" + re.escape(n) + r"\b", t) for n, s in own if s):
                out.add((i, entity, "surname"))
    return out


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_mentions_against_brute_force(spark, block):
    rng = random.Random(3)
    names = [(1, "Ann Menéndez", False), (1, "Menéndez", True), (2, "Bo Li", False), (2, "Li", True), (3, "O'Neil", True), (3, "Jo O'Neil", False), (4, "Bo Lindt", False), (4, "Lindt", True), (5, None, True), (6, "", False), (7, "-x-", True), (8, "ann", True), (9, "日本", False)]
    parts = ["ann menendez", "Menéndez", "MENENDEZ's", "menendezes", "Li", "Bo", "li_", "Lindt", "O’Neil", "o'neil", "-x-", "a-x-b", "Ann", "annual", "\n", ",", "ß", "日本"]
    texts = [(i, rng.choice([None, "", *(" ".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(8))]), rng.choice([None, "Bo Li", "menéndez", "x"])) for i in range(250)] + [(999, "x " * 200_000 + "Bo Lindt", None)]
    got = mentions.find_mentions(spark.createDataFrame(texts, "id int, text string, author string"), "id", ["text", "author"], spark.createDataFrame(names, "who int, alias string, short boolean"), "who", "alias", "short", block_chars=block)
    assert got.columns == ["id", "who", "via"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain_mentions(texts, names)


def test_alias_is_the_first_long_word_after_folding(spark, tmp_path):
    from quillspark.plans.timelines import alias_mentions

    items = [(1, "Den dem ein Straßen langeswort hier"), (2, "a b c stra–ssen")]  # folded: straen, too short; strassen
    docs = [(1, "Im Straen hier", None), (2, "ein langeswort", None), (3, "Ein LANGESWORT hier", None), (4, "strassen", "x")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, alias_mentions(spark, str(tmp_path)).collect())) == [(2, 1, "surname"), (3, 1, "surname"), (4, 2, "surname")]


def test_mentions_of_nobody_and_unfolded(spark):
    texts, names = spark.createDataFrame([(1, "One Two"), (1, "One Two"), (None, "two")], "place int, t string"), spark.createDataFrame([("k", "Two")], "via string, n string")
    assert sorted((str(r[0]), r[1]) for r in mentions.find_mentions(texts, "place", ["t"], names.selectExpr("via AS who", "n"), "who", "n", folded=False).collect()) == [("1", "k"), ("1", "k")]
    empty = mentions.find_mentions(texts, "place", ["t"], names.where("false").selectExpr("via AS who", "n"), "who", "n")
    assert empty.columns == ["place", "who", "via"] and empty.count() == 0


# pieces


def plain_chunks(text, size):
    """Character by character: what a reader with a pencil would do."""
    out, held = [], ""
    for p in text.split("\n"):
        if held and len(held) + 1 + len(p) > size:
            out.append(held)
            held = ""
        held = held + "\n" + p if held else p
        while len(held) > size:
            out, held = [*out, held[:size]], held[size:]
    return out + [held] * bool(held.strip())


def test_pieces_against_plain_ones(spark):
    rng = random.Random(8)
    texts = ["\n".join("é" * rng.choice([0, 0, 1, 3, 9, 10, 11, 20, 21, 35]) for _ in range(rng.randint(1, 9))) for _ in range(300)] + [None, "", "\n\n", " \n ", "x" * 100]
    got = {}
    for r in chunks.paragraph_chunks(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", 10).orderBy("id", "chunk").collect():
        got.setdefault(r["id"], []).append(r["text"])
        assert r["chunk"] == len(got[r["id"]]) - 1
    assert got == {i: plain_chunks(t, 10) for i, t in enumerate(texts) if t and plain_chunks(t, 10)}
    assert len(got[304]) == 10 and chunks.paragraph_chunks(spark.createDataFrame([], "id int, text string"), "id", "text", 10).count() == 0


def test_a_long_section_is_cut_and_nothing_is_lost():
    text = "word " * 40_000
    pieces = list(chunks.chunk_paragraphs(text.split("\n"), 5000))
    assert len(pieces) == 40 and "".join(pieces) == text and max(map(len, pieces)) == 5000
    many = list(chunks.chunk_paragraphs(("p" for _ in range(1_000_000)), 999))
    assert len(many) == 2000 and {len(p) for p in many} == {999}
    with pytest.raises(ValueError):
        next(chunks.chunk_paragraphs(["a"], 0))


def plain_division(sizes, limit):
    out, window, filled = [], 0, 0
    for k, n in enumerate(sizes):
        if filled and filled + n > limit:
            window, filled = window + 1, 0
        start = 0
        while n - start > limit:
            out.append((k, window, start, limit))
            start, window = start + limit, window + 1
        out.append((k, window, start, n - start))
        filled += n - start
    return out


def test_divided_items(spark):
    rng = random.Random(6)
    groups = {g: [rng.choice([None, 0, 1, 4, 7, 10, 11, 25, 100]) for _ in range(rng.randint(1, 40))] for g in ("a", "b", None)}
    rows = [(g, k, n, "x") for g, sizes in groups.items() for k, n in enumerate(sizes)]
    rng.shuffle(rows)
    got = {}
    for r in chunks.divide(spark.createDataFrame(rows, "g string, k int, n int, window string"), ["g"], "k", "n", 10).collect():
        got.setdefault(r["g"], []).append((r["k"], r["window"], r["start"], r["length"]))
    assert {g: sorted(x) for g, x in got.items()} == {g: plain_division([n or 0 for n in sizes], 10) for g, sizes in groups.items()}


def test_a_million_items_in_one_group(spark):
    found = chunks.divide(spark.range(1_000_000).selectExpr("'g' AS g", "id AS k", "7 AS n"), ["g"], "k", "n", 20)
    r = found.selectExpr("count(*) AS rows", "max(window) AS last", "sum(length) AS units").first()
    assert (r["rows"], r["last"], r["units"]) == (1_000_000, 499_999, 7_000_000)
