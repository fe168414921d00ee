import pytest
from pyspark.sql import functions as F

from quillspark.operators import votes

PARTIES = {"North Alliance": "North", "South Union": "South", "East First": "East", "Te Kōwhai": "Kōwhai", "Te Koowhai": "Kōwhai"}
CALLED = "A party vote was called for on the question, That the {} be now read a second time ."


def parsed(spark, lines, parties=PARTIES, day="2026-05-27"):
    rows = [(day, i, x) for i, x in enumerate(lines)]
    return votes.division_records(spark.createDataFrame(rows, "day string, ord int, text string").repartition(5), ["day"], "ord", "text", parties).orderBy("division_id").collect()


@pytest.mark.parametrize(
    "line, want",
    [
        ("North Alliance 48; South Union 11; East First 8.", True),
        ("North Alliance 34; Te Kōwhai 4; Ferris; Kapa-Kingi.", True),
        ("North Alliance 49; East First 8.", True),
        ("North Alliance 34, South Union 15, East First 11.", True),
        ("Te Koowhai 6; South Union 34.", True),
        ("", False),
        ("SPEAKER : The question is that the motion be agreed to.", False),
        ("The result corrected after originally being announced as Ayes 82, Noes 35", False),
        ("A party vote was called for on the question, That the motion be agreed to .", False),
        ("The bill was divided into the Contracts Bill and another, as set out on Paper 12.", False),
        ("Amendment to the amendment not agreed to.", False),
        ("Imaginary Party of Nowhere 12; South Union 34.", False),
        ("Ferris; Kapa-Kingi.", False),
        ("North Alliance 1; " * 30, False),
    ],
)
def test_tally_lines(spark, line, want):
    (r,) = spark.createDataFrame([(line,)], "x string").select(votes.is_tally(votes.clean(F.col("x")), PARTIES).alias("y")).collect()
    assert r["y"] is want


@pytest.mark.parametrize(
    "line, want",
    [
        ("Amendment to the amendment not agreed to.", "not_agreed"),
        ("Motion agreed to.", "agreed"),
        ("Bill read a third time.", "agreed"),
        ("Amendment negatived.", "not_agreed"),
        ("A party vote was called for on the question, That Part 2 be agreed to.", None),
        ("CHAIRPERSON (Ann Lee) : The question is that the motion be agreed to.", None),
        ("", None),
    ],
)
def test_verdicts(spark, line, want):
    (r,) = spark.createDataFrame([(line,)], "x string").select(votes.verdict(F.col("x")).alias("y")).collect()
    assert r["y"] == want


def test_bills(spark):
    questions = {
        "That the Rivers (Restoring of Banks) Amendment Bill be now read a third time": ["Rivers (Restoring of Banks) Amendment Bill"],
        "That the Gangs Bill and the Sentencing Amendment Bill be now read a third time": ["Gangs Bill", "Sentencing Amendment Bill"],
        "That the report of the Health Committee on the Clinics (Healthy Futures) Amendment Bill be agreed to": ["Clinics (Healthy Futures) Amendment Bill"],
        "That the Education and Training Amendment Bill (No 2) be now read a first time": ["Education and Training Amendment Bill (No 2)"],
        "That debate on this question now close": [],
    }
    rows = spark.createDataFrame([(q,) for q in questions], "q string").select("q", votes.bills_in_question(F.col("q")).alias("b")).collect()
    assert {r["q"]: r["b"] for r in rows} == questions
    headings = {"Social Security (Modern) Amendment Bill": 1, "Arms Amendment Bill, Third Reading": 1, "Education Amendment Bill (No 2)": 1, "GLEN LEE (Party) : I cannot support the Arms Bill at all.": 0, "That the Arms Bill be now read a second time": 0, "Prose.": 0}
    rows = spark.createDataFrame([(q,) for q in headings], "q string").select("q", votes.bills_in_heading(F.col("q")).alias("b")).collect()
    assert {r["q"]: len(r["b"]) for r in rows} == headings


def test_two_votes_of_a_day(spark):
    first, second = parsed(spark, [
        "Clean Arms Bill", "Hon MP (Minister) : I move, That the Clean Arms Bill be now read a second time.", CALLED.format("Clean Arms Bill"),
        "North Alliance 48; East First 11; Te Kōwhai 8.", "South Union 34; Te Koowhai 19; Ferris.", "Bill read a second time.",
        "A party vote was called for on the question, That debate on this question now close .", "South Union 49.", "North Alliance 48; East First 19.",
    ])
    assert (first["division_id"], first["type"], first["bills"], first["bill_source"]) == ("2026-05-27-001", "second_reading", ["Clean Arms Bill"], "question")
    assert first["ayes"]["parties"] == {"North": 48, "East": 11, "Kōwhai": 8} and first["ayes"]["total"] == 67
    assert first["noes"]["members"] == ["Ferris"] and first["noes"]["total"] == 54
    assert (first["result"], first["verdict_line"], first["flags"]) == ("agreed", "Bill read a second time.", ["ayes_order_inferred"])
    assert (second["type"], second["substantive"], second["bills"], second["bill_source"]) == ("closure", False, ["Clean Arms Bill"], "carried_forward")
    assert (second["result"], second["verdict_line"], second["flags"]) == ("not_agreed", None, ["ayes_order_inferred", "result_from_totals"])


LABELLED = ["Ayes 83", "North Alliance 48; South Union 15; East First 19; Kapa-Kingi.", "Noes 34", "Te Kōwhai 34.", "Motion agreed to."]
WRAPPED = ["Ayes 102", "North Alliance 49; South Union 34; East First 11;", "Te Kōwhai 8.", "Noes 21", "South Union 15; East First 6.", "Motion agreed to."]
UNSTOPPED = ["Ayes 102", "North Alliance 49; South Union 34;", "East First 19", "Noes 21", "South Union 21", "Motion agreed to."]


@pytest.mark.parametrize("lines, ayes, noes", [(LABELLED, 83, 34), (WRAPPED, 102, 21), (UNSTOPPED, 102, 21)])
def test_labelled_tallies_close_by_stop_or_by_declared_total(spark, lines, ayes, noes):
    (r,) = parsed(spark, [CALLED.format("Clean Arms Bill"), *lines])
    assert (r["ayes"]["total"], r["ayes"]["declared_total"], r["noes"]["total"], r["noes"]["declared_total"]) == (ayes, ayes, noes, noes)
    assert (r["result"], r["verdict_line"], r["flags"]) == ("agreed", "Motion agreed to.", ["ayes_labelled"])


def test_odd_blocks(spark):
    cases = [
        (["Ayes 99", "North Alliance 48.", "Noes 34", "South Union 34."], (48, 34, None), {"tally_mismatch", "ayes_labelled", "result_from_totals"}),
        (["Ayes 60", "North Alliance 59; Ferris.", "Noes 49", "South Union 49.", "Abstentions 8", "East First 8."], (60, 49, 8), {"ayes_labelled", "result_from_totals"}),
        (["North Alliance 48.", "SPEAKER : Order.", "South Union 34."], (48, None, None), {"ayes_order_inferred", "unopposed", "result_from_totals"}),
        (["Ayes 5", "Noes 3", "South Union 3."], (None, None, None), {"no_vote_lines"}),
        (["North Alliance 10; Ferris; North Alliance 5."], (16, None, None), {"ayes_order_inferred", "unopposed", "result_from_totals"}),
        (["", "North Alliance 48."], (None, None, None), {"no_vote_lines"}),
        (["North Alliance 1.", "South Union 2.", "East First 3.", "Te Kōwhai 4."], (1, 2, 3), {"ayes_order_inferred", "result_from_totals"}),
        (["North Alliance 7.", "South Union 9.", "Motion agreed to."], (7, 9, None), {"ayes_order_inferred", "verdict_conflicts_with_totals"}),
        (["North Alliance 7; South Union 9"], (None, None, None), {"no_vote_lines"}),
        ([None, None], (None, None, None), {"no_vote_lines"}),
    ]
    lines = [x for block, _, _ in cases for x in [CALLED.format("Clean Arms Bill"), *block]]
    for r, (block, totals, flags) in zip(parsed(spark, lines), cases):
        assert tuple(r[s]["total"] if r[s] else None for s in votes.SIDES) == totals, block
        assert set(r["flags"]) == flags, block


def test_long_blocks_days_and_free_names(spark):
    ayes = [f"Party {chr(65 + i % 26)}{chr(65 + i // 26)} 2;" for i in range(199)] + ["Tail 1."]
    (r,) = parsed(spark, [CALLED.format("Clean Arms Bill"), *ayes, "Tide 9.", "Motion agreed to."], parties=None)
    assert (r["ayes"]["total"], len(r["ayes"]["parties"]), r["noes"]["total"], r["result"], r["verdict_line"]) == (399, 200, 9, "agreed", "Motion agreed to.")
    rows = [("a", 0, "Clean Arms Bill"), ("a", 1, CALLED.split("{}")[0]), ("b", 0, "A party vote was called for on the question, That urgency be accorded."), ("b", 1, "North Alliance 3.")]
    table = spark.createDataFrame([(d, i, x, 1) for d, i, x in rows], "day string, at int, line string, vote int")
    a, b = votes.division_records(table, ["day"], "at", "line", PARTIES).orderBy("day").collect()
    assert (a["bills"], b["bills"], b["bill_source"], b["type"], b["substantive"]) == (["Clean Arms Bill"], None, None, "urgency", False)
    assert votes.division_records(table.limit(0), ["day"], "at", "line").count() == 0
