import pytest
from pyspark.sql import functions as F

from quillspark.functions import names
from quillspark.operators import questions


def pairs(spark, lines, day="2026-05-27"):
    return questions.question_pairs(spark.createDataFrame([(day, i, x) for i, x in enumerate(lines)], "day string, ord int, text string").repartition(4), ["day"], "ord", "text").orderBy("question_id").collect()


def test_names(spark):
    want = {
        "Rt Hon CHRISTINE LARK (Prime Minister)": "Christine Lark", "Hon NICOLA WILD (Minister of Finance) (14:44)": "Nicola Wild", "DAN BIDE (North—Northcote)": "Dan Bide", "WINSTON PERRY  on behalf of the Prime Minister": "Winston Perry",
        "David Seym )": "David Seym", "Lark, Rt Hon Ann": "Rt Hon Ann Lark", "TĀMATI KAPA-KINGI": "Tāmati Kapa-Kingi", "Dr Mrs Lee": "Lee", "": "", "Honora Lee": "Honora Lee",
    }
    got = spark.createDataFrame([(x,) for x in want], "x string").select("x", names.clean(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in got} == want
    folded = {"Ménéndez  ŁÓDŹ": "menendez łodz", "Ǻngström ẞ": "angstrom ß", "éa": "ea", "Nguyễn": "nguyen", "Te Pāti": "te pati"}
    got = spark.createDataFrame([(x,) for x in folded], "x string").select("x", names.fold(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in got} == folded
    same = [("Rt Hon CHRISTINE LARK (Prime Minister)", "Rt Hon Christine Lark", True), ("Chris Lark", "Christine LARK", True), ("Ann Lark", "Ann Lee", False), ("", "", False), (None, "A", False)]
    got = spark.createDataFrame(same, "a string, b string, w boolean").select(names.same_person(F.col("a"), F.col("b")).alias("g"), "w").collect()
    assert all(r["g"] == r["w"] for r in got)


@pytest.mark.parametrize(
    "line, want",
    [
        ("Hon TAMA POTAE (Minister for Roads: The Rest) : Kia ora.", ("Hon TAMA POTAE (Minister for Roads: The Rest)", "Kia ora.")),
        ("Ann (a (b: c) d): said: so", ("Ann (a (b: c) d)", "said: so")),
        ("David Seym ) : Yes.", ("David Seym )", "Yes.")),
        ("Just some prose", (None, None)),
        ("Open (bracket : no", (None, None)),
        ("A: too short", (None, None)),
        ("x" * 91 + ": too long", (None, None)),
        ("y" * 100_000, (None, None)),
    ],
)
def test_turns(spark, line, want):
    speaker, said = questions.split_turn(F.col("x"))
    (r,) = spark.createDataFrame([(line,)], "x string").select(speaker.alias("a"), said.alias("b")).collect()
    assert (r["a"], r["b"]) == want


OLD = [
    "Prose before: not a turn of a block.", "Question No. 1—Prime Minister", "1. Rt Hon CHRIS HILL (Leader of the Opposition) to the Prime Minister: Does she stand by her statements?",
    "Rt Hon CHRISTINE LARK (Prime Minister): Yes.", "SPEAKER: Order.", "Rt Hon Christine Lark: I said yes.", "Hon Member: Shame!", "Rt Hon Chris Hill: Point of order, Mr Speaker.", "Rt Hon Chris Hill: Why?",
    "Ann Other: Because?", "Rt Hon Chris Hill: Really, why?", "Rt Hon CHRISTINE LARK: Because.", "Rt Hon Chris Hill: And unanswered?",
]
NEW = ["Question No. 2", "DAN BIDE (North—Northcote) (14:44) to the Minister of Finance : What now?", "Hon WINSTON PERRY (Minister) on behalf of the Minister of Finance: This.", None, "No colon here"]


def test_both_styles_of_blocks(spark):
    got = pairs(spark, [*OLD, "Question No. 7—Empty", "No primary question.", *NEW])
    assert [r["question_id"] for r in got] == ["2026-05-27-b01-0", "2026-05-27-b01-1", "2026-05-27-b02-0"]
    a, b, c = got
    assert (a["number"], a["portfolio"], a["asker"], a["addressee"], a["responder"]) == (1, "Prime Minister", "Chris Hill", "Prime Minister", "Christine Lark")
    assert (a["question"], a["answer"], a["is_primary"], a["supplementary_index"]) == ("Does she stand by her statements?", "Yes.", True, None)
    assert (b["question"], b["answer"], b["is_primary"], b["supplementary_index"]) == ("Really, why?", "Because.", False, 2)
    assert (c["number"], c["portfolio"], c["asker"], c["addressee"], c["responder"], c["question"], c["answer"]) == (2, None, "Dan Bide", "Minister of Finance", "Winston Perry", "What now?", "This.")
    assert pairs(spark, ["Nothing here"]) == []


def test_uniform_rows(spark):
    oral = spark.createDataFrame([("d-b01-0", "2026-01-01", "Ann", "Bob", "Why?", "So.")], "question_id string, date string, asker string, responder string, question string, answer string")
    written = spark.createDataFrame([(1, "2026-02-01", "Cy", "Di", "How?", "Thus.", True, False), (2, None, "Cy", "Di", "When?", None, False, False), (3, None, "Cy", "Di", "File?", "see", True, True), (4, None, None, "Di", None, None, True, None)], "question_id bigint, released_date string, asker string, minister string, question string, reply string, answered boolean, attachment_only boolean")
    assert sorted(tuple(r) for r in questions.uniform_pairs(oral, written).collect() if r["asker"]) == [("oral", "d-b01-0", "2026-01-01", "Ann", "Bob", "Why?", "So."), ("written", "1", "2026-02-01", "Cy", "Di", "How?", "Thus.")]
    assert {r["id"] for r in questions.uniform_pairs(oral, written).collect()} == {"d-b01-0", "1", "4"}
