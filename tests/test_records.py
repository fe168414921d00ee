import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import records as R

D = datetime.date


@pytest.fixture
def calc(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("r")).first()["r"]


def test_projections(calc):
    lit = F.lit
    none = lit(None).cast("string")
    assert [calc(R.outcome(lit(a), lit(s))) for a, s in (("2024-01-01", "active"), (None, "Terminated"), ("", "active"), (None, None))] == ["enacted", "terminated", "in_progress", "in_progress"]
    assert calc(R.in_term(lit(53), 54, F.array(lit("2023-01-01"), lit("2024-02-02T00")), "2023-10-14")) and not calc(R.in_term(lit(53), 54, F.array(none), "2023-10-14"))
    assert [x["date"] for x in calc(R.by_date(F.array(*(F.struct(lit(d).alias("date")) for d in ("2024", None, "2023")))))] == [None, "2023", "2024"]
    assert calc(R.is_pending(none)) and calc(R.is_pending(lit("Reply due: 3 May"))) and not calc(R.is_pending(lit("Yes.")))
    assert calc(R.labelled([("Title", lit("A")), ("Date", none), ("Text", lit("b"))])) == "Title: A\n\nText: b"
    assert calc(R.value_of(lit("mixed"), {"true": 1.0, "mixed": 0.5})) == 0.5 and calc(R.value_of(lit("?"), {"true": 1.0})) is None
    assert calc(R.live_or_archived(lit("u"), lit(False))).endswith("/2/u") and calc(R.live_or_archived(lit("u"), lit(None).cast("boolean"))) == "u"
    assert [calc(R.url_state(lit(s))) for s in (200, 404, 410, 500)] == ["live", "dead", "dead", "unknown"]
    assert calc(R.first_keyword(lit("The Green and Red lists"), [("red", "R"), ("green", "G")])) == "R"
    assert [calc(R.band(lit(v), 5)) for v in (0, 25, 35, 100, 130, None)] == [1, 2, 4, 10, 10, 5]
    assert [calc(R.clamp(lit(v))) for v in (-1.0, 0.5, 7.0)] == [0.0, 0.5, 1.0] and calc(R.clamp(lit(None).cast("double"))) is None
    assert [calc(R.subject(lit(v), lit(o))) for v, o in (("other", True), ("other", False), ("odd", True), (None, True))] == ["other", "speaker", "speaker", "speaker"]
    assert calc(R.without_honorifics(lit("Rt Hon Dr  Zoë Lee"))) == "zoe lee"
    assert calc(R.split_id(lit("w#1|focus|3@m"))).asDict() == {"window": "w#1", "attribute": "focus", "idx": 3} and calc(R.split_id(lit("a|b"))) is None
    assert calc(R.prefixed(F.create_map(lit("party:A"), lit(1), lit("member:B"), lit(2)), "party:")) == {"A": 1}
    assert calc(R.absolute_url(lit("/a"), "https://x.org/")) == "https://x.org/a" and calc(R.absolute_url(lit("//y.org/b"), "https://x.org")) == "https://y.org/b"
    assert calc(R.front_matter(lit("---\ntitle: A: b\ndraft: no\n---\ntext"))) == {"title": "A: b", "draft": "no"}
    assert calc(R.same_person(lit("Hon Ann Lee"), lit("Mr LEE"))) and not calc(R.same_person(lit("Ann Lee"), lit("Ann Low")))
    assert [calc(R.lead_and_rest(lit("one two three"), n)).asDict() for n in (9, 50)] == [{"lead": "one two", "rest": "three"}, {"lead": "one two three", "rest": ""}]
    p = calc(R.polar(lit(50.0), lit(0), lit(4)))
    assert (round(p["x"], 9), round(p["y"], 9)) == (0.0, -50.0)


def test_dates(calc):
    day = lambda y, m, d: F.lit(D(y, m, d))
    assert calc(R.days_apart(day(2024, 1, 1), day(2024, 1, 5))) == 4
    assert calc(R.cutoff(day(2024, 3, 31), 1)) == D(2024, 3, 1)
    assert calc(R.recent_or_undated(F.lit(None).cast("date"), day(2024, 1, 1)))
    assert calc(R.month_starts(day(2023, 12, 15), day(2024, 2, 1))) == [D(2023, 12, 1), D(2024, 1, 1), D(2024, 2, 1)]
    assert calc(R.weekdays_back(day(2024, 1, 8), 4)) == [D(2024, 1, 8), D(2024, 1, 5)]
    assert calc(R.night(F.lit(datetime.datetime(2024, 1, 2, 3)))) == D(2024, 1, 1)
    assert [calc(R.hour_window(F.lit(h), 22, 6)) for h in (23, 3, 12)] == [True, True, False]
    assert calc(R.months_between_at_least_one(day(2024, 1, 1), day(2024, 3, 2))) == 3


def test_sub_links(spark):
    links = spark.createDataFrame([(u,) for u in ("https://x.org/policy/a#top", "https://x.org/policy/a", "https://y.org/policy/a", "https://x.org/news", "https://x.org/policy/1/2/3/4/5")], "u string")
    assert [r["u"] for r in R.sub_links(links, "u", "https://X.org/policy", "^/policy").collect()] == ["https://x.org/policy/a"]
