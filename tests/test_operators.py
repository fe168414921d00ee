import datetime
import random
import statistics

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import evidence, incremental, match, packing, parsers, ranking, scorer, segments, stats


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()["r"]


def plain_shrink(groups):
    """The formula on lists, for one attribute."""
    every = [s for g in groups.values() for s in g]
    prior = statistics.fmean(every)
    var = lambda x: statistics.variance(x) if len(x) > 1 else 0.0
    pooled = [var(g) for g in groups.values() if len(g) >= 2]
    within = (statistics.fmean(pooled) if pooled else 0.0) or var(every)
    means = {k: statistics.fmean(g) for k, g in groups.items()}
    between = max(1e-6, var(list(means.values())) - within * statistics.fmean(1 / len(g) for g in groups.values()))
    within = max(1e-6, within)
    out = {}
    for k, g in groups.items():
        n = len(g)
        w = (n - 1) / (n + 3)
        v = within if n < 2 else max(1e-6, w * var(g) + (1 - w) * within)
        s = between / (between + v / n)
        out[k] = (n, s, s * means[k] + (1 - s) * prior)
    return out


def test_shrinkage(spark):
    rng = random.Random(1)
    groups = {k: [rng.random() * 0.3 + k / 10 for _ in range(rng.choice([1, 1, 2, 5, 40]))] for k in range(8)}
    rows = [(k, "a", s) for k, g in groups.items() for s in g] + [(99, "a", None)]
    got = {r["entity"]: r for r in stats.shrink(spark.createDataFrame(rows, "e int, a string, s double"), "e", "a", "s").collect()}
    want = plain_shrink(groups)
    assert set(got) == set(want)
    for k, (n, s, adjusted) in want.items():
        assert (got[k]["n"], got[k]["shrink"], got[k]["adjusted"]) == (n, pytest.approx(s), pytest.approx(adjusted))
    assert min(got.values(), key=lambda r: r["shrink"])["n"] == 1
    alone = stats.shrink(spark.createDataFrame([(1, "a", 0.4)], "e int, a string, s double"), "e", "a", "s").first()
    assert alone["adjusted"] == pytest.approx(0.4) and alone["display"] == 40


def test_pearson_guards(spark):
    df = spark.createDataFrame([("up", i, 2.0 * i) for i in range(5)] + [("flat", i, 1.0) for i in range(5)] + [("few", 1, 1.0), ("few", 2, 2.0)] + [("up", 9, None)], "g string, x int, y double")
    got = {r["g"]: r["r"] for r in df.groupBy("g").agg(stats.pearson(F.col("x"), F.col("y")).alias("r")).collect()}
    assert got["up"] == pytest.approx(1) and got["flat"] is None and got["few"] is None


def test_ranks(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 5.0), ("a", 4, None), ("b", 5, 7.0)], "g string, i int, v double")
    got = {r["i"]: r["p"] for r in df.withColumn("p", ranking.percentile_rank(F.col("v"), ["g"])).collect()}
    assert got == {1: 0.25, 2: 0.25, 3: 1.0, 4: None, 5: 0.5}
    numbered = ranking.global_row_number(spark.range(1000).withColumn("v", F.col("id") % 7), [F.col("v").desc(), F.col("id").asc()])
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert [r["id"] for r in numbered.orderBy("rank").collect()] == want and numbered.agg(F.max("rank")).first()[0] == 1000
    assert ranking.global_row_number(spark.range(0), [F.col("id")]).count() == 0


@pytest.mark.parametrize("n", [1, 3, 4, 10, 11])
def test_samples(spark, n):
    df = spark.range(n).withColumn("g", F.lit(1))
    assert [r["id"] for r in ranking.stride_sample(df, ["g"], [F.col("id")], 3).orderBy("id").collect()] == (list(range(n)) if n <= 3 else [i * n // 3 for i in range(3)])
    assert [r["id"] for r in ranking.spread_pick(df, ["g"], [F.col("id")], 4).orderBy("id").collect()] == (list(range(n)) if n <= 4 else sorted({round(i * (n - 1) / 3) for i in range(4)}))


def test_packing(spark):
    rng = random.Random(2)
    sizes = [rng.choice([1, 5, 20, 90, 500]) for _ in range(200)]
    for most in (None, 3):
        window = total = n = 0
        want = []
        for s in sizes:
            if n and (total + s > 100 or most and n >= most):
                window, total, n = window + 1, 0, 0
            total, n = total + s, n + 1
            want.append(window)
        df = spark.createDataFrame(list(enumerate(sizes)), "i int, s int").withColumn("g", F.lit("x"))
        assert [r["window"] for r in packing.pack(df, ["g"], "i", F.col("s"), 100, most).orderBy("i").collect()] == want


def test_segments(spark):
    turns = [(1, "A"), (2, None), (3, "B"), (4, "B"), (5, "!"), (6, None), (7, "B"), (8, "A")]
    df = spark.createDataFrame([(1, i, s) for i, s in turns], "g int, i int, s string")
    got = segments.speaker_blocks(df, ["g"], [F.col("i")], F.when(F.col("s") != "!", F.col("s")), F.coalesce(F.col("s") == "!", F.lit(False))).orderBy("block").collect()
    assert [(r["speaker"], r["n"], r["first_at"]) for r in got] == [("A", 2, 1), ("B", 2, 3), ("B", 1, 7), ("A", 1, 8)]
    qa = spark.createDataFrame([(1, i, k) for i, k in enumerate("qqaaqaxa")], "g int, i int, k string")
    got = segments.pair_answers(qa, ["g"], "i", F.col("k") == "q", F.col("k") == "a").orderBy("question").collect()
    assert [(r["question"], r["answer"], r["supplementary"]) for r in got] == [(1, 2, 1), (4, 5, 2)]


def test_text_functions(spark):
    assert one(spark, "Rt Hon  Zoë (Acting) Märtin", "string", lambda c: T.fold_name(T.clean_name(c))) == "zoe martin"
    assert one(spark, "Smith, Hon Ann", "string", T.clean_name) == "Hon Ann Smith"
    assert one(spark, " “It’s  late…” ", "string", T.quote_key) == "it's late"
    assert one(spark, "Paid 1,200.50 and 3", "string", T.template_key) == "paid # and #"
    assert one(spark, "a b c d", "string", lambda c: T.shingles(T.words(c), 3)) == ["a b c", "b c d"]
    assert one(spark, "a b", "string", lambda c: T.shingles(T.words(c), 3)) == []
    assert one(spark, "on 2024-13-01 then 2024-02-03", "string", T.first_date) is None
    assert one(spark, "on 2024-02-03x", "string", T.first_date) == datetime.date(2024, 2, 3)
    for text in ("18 June 2026", "Jun 18, 2026", "18/6/2026"):
        assert one(spark, text, "string", T.long_date) == datetime.date(2026, 6, 18)
    assert one(spark, "https://x.org/2026/6/18/a", "string", T.url_date) == datetime.date(2026, 6, 18)
    assert one(spark, "https://www.Example.org:80/a", "string", T.host) == "example.org"
    assert one(spark, "```json\n[1, 2]\n``` done", "string", T.json_array) == "[1, 2]"
    source = F.lit("We said that the roads were bad last year, and later that the bridges were quite unsafe for all.")
    for quote, kind in (("The roads were bad last year", "verbatim"), ("the roads were bad last year… the bridges were quite unsafe", "spliced"), ("the roads were good", "missing")):
        assert one(spark, quote, "string", lambda c: T.quote_class(c, source)) == kind


def test_matches_are_refused_when_ambiguous(spark):
    roster = spark.createDataFrame([(1, "Ann Smith"), (2, "Bob Smith"), (3, "Cy Jones"), (4, "Ann Smith")], "id int, name string")
    got = {r["m"]: (r["id"], r["via"]) for r in match.resolve_names(spark.createDataFrame([("Hon Bob Smith",), ("Ann Smith",), ("Smith",), ("Dr Jones",)], "m string"), "m", roster, "id", "name").collect()}
    assert got == {"Hon Bob Smith": (2, "name"), "Ann Smith": (None, None), "Smith": (None, None), "Dr Jones": (3, "surname")}
    fuzzy = {r["m"]: r["id"] for r in match.resolve_fuzzy(spark.createDataFrame([("Bobb Smith",), ("An Smith",), ("Nobody",)], "m string"), "m", spark.createDataFrame([(1, "Ann Smith"), (2, "Bob Smith"), (5, "Anna Smith")], "id int, name string"), "id", "name").collect()}
    assert fuzzy == {"Bobb Smith": 2, "An Smith": None, "Nobody": None}
    titles = spark.createDataFrame([("Fair Water Bill",), ("Clean Water and Air Bill",), ("Road Safety Bill",)], "t string")
    queries = spark.createDataFrame([("the water fair bill",), ("Water",), ("Road Safety Amendment",), ("Tax",)], "q string")
    got = {r["q"]: (r["title"], r["via"]) for r in match.resolve_titles(queries, "q", titles, "t").collect()}
    assert got == {"the water fair bill": ("Fair Water Bill", "equal"), "Water": (None, None), "Road Safety Amendment": ("Road Safety Bill", "contained"), "Tax": (None, None)}


def test_verdicts(spark):
    s = spark.createDataFrame([(1, "a", 0.4, 0.9), (2, "b", None, 0.9), (3, "c", None, 0.9), (4, "d", None, 0.9), (5, "e", None, None)], "k int, statement string, score double, prior double")
    v = spark.createDataFrame([(1, "a", "true"), (2, " b ", "true"), (3, "other", "true"), (4, "d", "unclear")], "k int, statement string, verdict string")
    got = {r["k"]: (r["state"], r["score"], r["prior_score"]) for r in incremental.join_verdicts(s, v, ["k"], {"true": 1.0}).collect()}
    assert got == {1: ("scored", 0.4, None), 2: ("resolved", 1.0, 0.9), 3: ("stale", None, 0.9), 4: ("pending", None, 0.9), 5: ("prior", None, None)}


def test_resume_is_idempotent(spark):
    plan, done = spark.range(6).toDF("k"), spark.createDataFrame([(1,), (1,), (4,)], "k bigint")
    left = incremental.todo(plan, done, ["k"])
    assert sorted(r["k"] for r in left.collect()) == [0, 2, 3, 5]
    assert incremental.todo(plan, done.unionByName(left), ["k"]).count() == 0
    merged = incremental.upsert(plan.withColumn("v", F.lit("old")), done.distinct().withColumn("v", F.lit("new")), ["k"])
    assert merged.where("v = 'new'").count() == 2 and merged.count() == 6


def test_gate_and_scorer(spark):
    df = spark.createDataFrame([(1, "Good one.", True, 0.5), (2, "Good one.", False, 0.5), (3, "cut one.", True, 0.5), (4, "Cut", True, 0.5), (5, "Good.", True, None)], "k int, t string, v boolean, s double")
    got = {r["k"]: r["r"] for r in df.withColumn("r", evidence.reject_reason(F.col("v"), F.col("t"), F.col("s"))).collect()}
    assert got == {1: None, 2: "not_verbatim", 3: "cut_start", 4: "cut_end", 5: "no_score"}

    class Wild:
        def __call__(self, texts):
            return [[("a", t, 7.0), ("b", t, None)] for t in texts]

    rows = scorer.score(spark.createDataFrame([(1, "x")], "window_id int, text string"), Wild()).orderBy("idx").collect()
    assert [(r["attribute"], r["score"]) for r in rows] == [("a", 1.0), ("b", None)]


def test_exploded_examples(spark):
    df = spark.createDataFrame([("d#0", {"focus": [("x", 0.5), ("y", None)]})], "window_id string, m map<string,array<struct<statement:string,score:double>>>")
    got = evidence.explode_examples(df, ["window_id"], "m").orderBy("idx").collect()
    assert [(r["attribute"], r["idx"], r["statement"], r["score"]) for r in got] == [("focus", 0, "x", 0.5), ("focus", 1, "y", None)]


LINES = [
    "The question was put that the Clean Rivers Bill be now read a third time.",
    "A party vote was called for on the question, That the Clean Rivers Bill be now read a third time.",
    "Ayes 68",
    "North Party 49; East Party 11; Independents: Lowe, Park 2; West 6.",
    "Noes 55",
    "South Party 34; Green Leaf 15; Tide 6.",
    "Motion agreed to.",
]


def test_votes(spark):
    df = spark.createDataFrame([("2025-03-04", i, line) for i, line in enumerate(LINES)], "day string, ord int, line string")
    (r,) = parsers.divisions(df, ["day"]).collect()
    assert (r["division_id"], r["type"], r["substantive"], r["bill"], r["result"]) == ("2025-03-04-001", "third_reading", True, "Clean Rivers Bill", "passed")
    assert r["ayes"]["parties"] == {"North Party": 49, "East Party": 11, "Independents": 2, "West": 6} and r["ayes"]["members"] == ["Lowe", "Park"]
    assert (r["ayes"]["total"], r["ayes"]["declared_total"], r["noes"]["total"], r["flags"]) == (68, 68, 55, [])
    wrong = [("2025-03-04", i, line.replace("Noes 55", "Noes 56").replace("agreed to", "not agreed to")) for i, line in enumerate(LINES)]
    (r,) = parsers.divisions(spark.createDataFrame(wrong, "day string, ord int, line string"), ["day"]).collect()
    assert r["result"] == "passed" and set(r["flags"]) == {"noes_total_mismatch", "verdict_mismatch"}


def test_wrapped_and_bare_tallies(spark):
    wrapped = [*LINES[:3], "North Party 49; East Party", "11; Independents: Lowe,", "Park 2; West 6.", *LINES[4:]]
    bare = [line for line in LINES if not line.startswith(("Ayes", "Noes"))]
    abstained = [*LINES[:6], "Abstentions 2", "Plains 2.", "Motion agreed to."]
    for lines in (wrapped, bare, abstained):
        rows = [("2025-03-04", i, line) for i, line in enumerate(lines + ["Prose about 3 things.", *LINES[1:]])]
        first, second = parsers.divisions(spark.createDataFrame(rows, "day string, ord int, line string"), ["day"]).orderBy("division_id").collect()
        for r in (first, second):
            assert (r["ayes"]["total"], r["noes"]["total"], r["result"], r["verdict_line"], r["flags"]) == (68, 55, "passed", "Motion agreed to.", [])


def test_question_kinds(spark):
    rows = [("That the Electoral Amendment Bill be reported to the House by 1 December", "committee_report"), ("That Part 1 as amended be agreed to", "committee"), ("That the amendment be agreed to", "amendment"), ("That leave be granted", "other")]
    got = spark.createDataFrame(rows, "q string, want string").withColumn("got", parsers.question_type(F.col("q"))).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_every_sentence_is_scored():
    (found,) = scorer.RuleScorer()(["One two three. Four four four four.. "])
    assert [(a, s, v) for a, s, v in found] == [("focus", "One two three", 0.075), ("variety", "One two three", 1.0), ("focus", "Four four four four", 0.1), ("variety", "Four four four four", 0.25)]


def test_spoken_turns(spark):
    rows = [(1, i, s) for i, s in enumerate(["Dr ANN SMITH (Minister of Roads): We will build.", "Without a tag here.", "SPEAKER: Order.", "BOB JONES: Why: because?", "no speaker"])]
    got = parsers.speaker_lines(spark.createDataFrame(rows, "d int, ord int, line string"), "line").orderBy("ord").collect()
    assert [(r["speaker"], r["said"]) for r in got] == [("Dr ANN SMITH (Minister of Roads)", "We will build."), (None, "Without a tag here."), ("SPEAKER", "Order."), ("BOB JONES", "Why: because?"), (None, "no speaker")]


def test_scorer_gets_bounded_batches(spark):
    class Bounded:
        def __call__(self, texts):
            if len(texts) > 1 and sum(len(t or "") for t in texts) > scorer.PIECE_BYTES:
                raise ValueError("too much at once")
            return [[("a", "s", 0.5)] * (0 if t is None else 3) for t in texts]

    long = "x" * (scorer.PIECE_BYTES // 2 - 10)
    rows = spark.createDataFrame([(i, None if i == 4 else long * 3 if i == 2 else long) for i in range(9)], "window_id int, text string").coalesce(1)
    got = sorted(tuple(r) for r in scorer.score(rows, Bounded()).collect())
    assert got == sorted((i, "a", k, "s", 0.5) for i in range(9) if i != 4 for k in range(3))


def test_scorer_bounds_what_spark_gathers(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = spark.createDataFrame([(i, "x" * (1 << 20)) for i in range(30)], "window_id int, text string").coalesce(1)
    largest = lambda: rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n bigint").agg(F.max("n")).first()[0]
    try:
        spark.conf.set(key, "64m")
        assert largest() >= 30 << 20
        scorer.score(rows, scorer.RuleScorer())
        assert largest() <= 8 << 20
        spark.conf.set(key, "2m")
        scorer.score(rows, scorer.RuleScorer())
        assert spark.conf.get(key) == "2m"
    finally:
        spark.conf.set(key, before)
