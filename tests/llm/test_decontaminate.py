import pandas as pd
from pyspark.sql import functions as F

from quillspark.llm import decontaminate as dc
from quillspark.llm import queries
from tests.conftest import SF
from tests.llm.helpers import docs_of

ITEM = "A farmer sells 12 kg of apples to Maria for 30 dollars and then gives 12 apples away to every child she knows"
SAME = ITEM.lower().replace("maria", "Maria").capitalize()
OTHER = "A farmer sells 45 kg of apples to Pedro for 31 dollars and then gives 45 apples away to every child she knows"
MIXED = "A farmer sells 45 kg of apples to Pedro for 31 dollars and then gives 46 apples away to every child she knows"
SHORT = "Zebras seldom swim very far"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_templates(spark):
    row = spark.createDataFrame([("In 1,200.5 km, he met Anna. Bob ran 3 h! x2 5kg",)], "t string").select(dc.template(F.col("t")).alias("t"), dc.values(F.col("t")).alias("v")).first()
    n, u, m = dc._NUMBER, dc._UNIT, dc._NAME
    assert row["t"] == ["in", n, u, "he", "met", m, "bob", "ran", n, u, "x2", n, u]
    assert row["v"] == ["in", n + "12005", u + "km", "he", "met", m + "anna", "bob", "ran", n + "3", u + "h", "x2", n + "5", u + "kg"]


def test_slots_must_be_consistent(spark):
    around = "Some words before it. {} And some words after."
    rows = [(1, around.format(ITEM)), (2, around.format(OTHER)), (3, around.format(MIXED)), (4, "Nothing of the kind is here at all, only other words"), (5, None), (6, ""), (None, ITEM), (7, ITEM), (7, ITEM), (8, f"so {SHORT.lower()} ok"), (9, " ".join(ITEM.split()[:9]))]
    got = {(r["doc_id"], r["item_id"]): (r["n_slots"], r["n_changed"]) for r in dc.find_leaks(docs_of(spark, rows), bench(spark, [(100, ITEM), (101, SHORT), (102, None), (103, "too short")])).collect()}
    assert set(got) == {(1, 100), (2, 100), (None, 100), (7, 100), (8, 101)}
    assert got[1, 100][1] == 0 and got[2, 100][1] == 4
    clean = dc.without_leaks(docs_of(spark, rows), bench(spark, [(100, ITEM), (101, SHORT)]))
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == ["3", "4", "5", "6", "9"]


def test_windows_poor_in_words_and_at_any_token(spark):
    sums, people = "What is 7 times 8", "Meet Anna Maria Pedro Ivan Olga Peter today"
    words = " ".join(f"word{chr(97 + k)}" for k in range(17))
    part = words.split()[1:10]  # nine tokens from the second on
    items = [(1, sums), (2, people), (3, words)]
    rows = [(1, "so, what is 7 times 8 then"), (2, f"I said: {people.replace('Meet', 'meet')} or not"), (3, "other start " + " ".join(part) + " other end"), (4, "so, what is 7 times 9 then"), (5, "nothing of all that")]
    assert {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs_of(spark, rows), bench(spark, items)).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_contradictions_outside_a_copied_run(spark):
    head = " ".join(f"head{chr(97 + k)}" for k in range(14)) + " then 12 apples and 30 pears"
    item = head + " plus another 12 coins with " + " ".join(f"tail{chr(97 + k)}" for k in range(12))
    copied = head + " somewhere quite 77 other than " + " ".join(f"else{chr(97 + k)}" for k in range(12))
    question = "If you add 3 stones to 4 stones in one bag how many do you carry home"
    rows = [(1, copied), (2, item.replace("another 12", "another 13")), (3, question.replace("3", "5").replace("4", "5"))]
    got = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in dc.find_leaks(docs_of(spark, rows), bench(spark, [(1, item), (2, question)])).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2)}
    assert got[1, 1] == 20 and got[2, 1] == 37 - 1 and got[3, 2] == 17 - 2


def test_empty_sides(spark):
    none = bench(spark, [])
    assert dc.find_leaks(docs_of(spark, [(1, ITEM)]), none).count() == 0
    assert dc.without_leaks(docs_of(spark, [(1, ITEM)]), none).count() == 1
    assert dc.find_leaks(docs_of(spark, []), bench(spark, [(1, ITEM)])).count() == 0


def test_shuffled_join_finds_the_same(spark, monkeypatch):
    rows = [(1, ITEM), (2, OTHER), (3, MIXED)]
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    assert sorted(r["doc_id"] for r in dc.find_leaks(docs_of(spark, rows), bench(spark, [(100, ITEM)])).collect()) == [1, 2]


def test_query_finds_verbatim_items(spark):
    docs, items = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(i, k) for i, t in zip(docs.doc_id, docs.text) for k, b in zip(items.item_id, items.text) if b in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op2_decontaminate(spark, SF).collect()}
    assert want and want <= got
