"""Queries of record projections: outcomes, dates, scores, ids, links, quotes and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import records as R
from quillspark.functions import text as T
from quillspark.operators import parsers
from quillspark.plans.registry import query, table
from quillspark.plans.texts import _KEY


def _pick(number: Column, *values: Column | str) -> Column:
    """The value of a number's remainder."""
    texts = [F.lit(v) if isinstance(v, str) else v for v in values]
    return F.get(F.array(*texts), (number % len(texts)).cast("int"))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'enacted' WHEN o_orderstatus = 'F' THEN 'terminated' ELSE 'in_progress' END AS outcome,
o_orderkey % 7 = 5 OR o_orderdate >= TIMESTAMP '1997-01-01' AS in_term FROM orders""")
def record_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of each record and whether it belongs to the term, by its number or any date."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    status = F.when(F.col("o_orderstatus") == "F", "Bill Withdrawn").otherwise("Select committee")
    in_term = R.in_term(k % 7 + 49, 54, F.array(F.lit(None).cast("string"), day), "1997-01-01")
    return table(spark, d, "orders").select(k.alias("id"), R.outcome(F.when(k % 3 == 0, day), status).alias("outcome"), in_term.alias("in_term"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 < 6 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates read from prose, numbers and URLs; impossible ones are NULL."""
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    shape = lambda pattern: F.date_format(t, pattern)
    text = _pick(
        k, F.concat(F.lit("Published "), shape("d MMMM yyyy")), shape("MMM d, yyyy"), shape("d/M/yyyy"), F.concat(F.lit("see "), shape("yyyy-MM-dd"), F.lit(" for more")),
        F.concat(F.lit("https://a.example.org/"), shape("yyyy/M/d"), F.lit("/story")), F.concat(F.lit("https://a.example.org/"), shape("d-M-yyyy")), "31 February 2021",
    )
    return table(spark, d, "orders").select(k.alias("id"), text.alias("t")).select("id", F.date_format(F.coalesce(T.first_date(F.col("t")), T.url_date(F.col("t")), T.long_date(F.col("t"))), "yyyy-MM-dd").alias("day"))


@query("""
WITH o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS t FROM orders)
SELECT id, strftime(t - 180, '%Y-%m-%d') AS cutoff, datediff('month', t - 180, t) + 1 AS months, len(list_filter(range(10), lambda i: isodow(t - CAST(i AS INTEGER)) <= 5)) AS weekdays,
strftime(t - CAST(greatest(0, isodow(t) - 5) AS INTEGER), '%Y-%m-%d') AS newest, CAST(greatest(1, round_even(datediff('day', DATE '1992-01-01', t) / 30.0, 0) + 1) AS INTEGER) AS span, id % 5 = 0 OR t >= DATE '1997-01-01' AS recent FROM o""")
def term_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Cutoff, months to visit, weekdays looked back on, months spanned and recency of each date."""
    k, t = F.col("o_orderkey"), F.to_date("o_orderdate")
    back, start = R.weekdays_back(t, 10), F.lit("1992-01-01").cast("date")
    return table(spark, d, "orders").select(
        k.alias("id"), F.date_format(R.cutoff(t, 6), "yyyy-MM-dd").alias("cutoff"), F.size(R.month_starts(R.cutoff(t, 6), t)).cast("bigint").alias("months"), F.size(back).cast("bigint").alias("weekdays"),
        F.date_format(F.get(back, F.lit(0)), "yyyy-MM-dd").alias("newest"), R.months_between_at_least_one(start, t).alias("span"), R.recent_or_undated(F.when(k % 5 != 0, t), F.lit("1997-01-01").cast("date")).alias("recent"),
    )


@query("SELECT event_type, count(*) AS n, count(*) FILTER (hour(ts) >= 22 OR hour(ts) < 6) AS at_night, count(*) FILTER (hour(ts) BETWEEN 9 AND 16) AS in_office FROM events GROUP BY 1")
def hours_of_work(spark: SparkSession, d: str) -> DataFrame:
    """Events in a window of hours that passes midnight, and in one that doesn't."""
    h = F.hour("ts")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(R.hour_window(h, 22, 6)).alias("at_night"), F.count_if(R.hour_window(h, 9, 17)).alias("in_office"))


@query("""
SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_returnflag = 'N' THEN 5 ELSE greatest(1, least(10, CAST(round_even(l_quantity * 2 / 10.0, 0) AS INTEGER))) END AS band, round(greatest(0.0, least(1.0, l_tax * 20 - 0.5)), 6) AS clamped,
round(l_quantity * 2 * cos(2 * pi() * (l_linenumber % 5) / 5 - pi() / 2), 6) + 0.0 AS x, round(l_quantity * 2 * sin(2 * pi() * (l_linenumber % 5) / 5 - pi() / 2), 6) + 0.0 AS y, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'other' ELSE 'speaker' END AS subject FROM lineitem""")
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    """Scores in whole bands (a default where there is none), clamped, on a radar's spokes, and whom they are about."""
    q, flag = F.col("l_quantity") * 2, F.col("l_returnflag")
    at = R.polar(q, F.col("l_linenumber") % 5, F.lit(5))
    named = F.when(F.col("l_linestatus") == "F", "other").otherwise("nobody known")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), R.band(F.when(flag != "N", q), 5).alias("band"), F.round(R.clamp(F.col("l_tax") * 20 - 0.5), 6).alias("clamped"),
        (F.round(at["x"], 6) + 0.0).alias("x"), (F.round(at["y"], 6) + 0.0).alias("y"), R.subject(named, flag == "A").alias("subject"),
    )


@query("""
SELECT CASE WHEN l_linenumber < 6 THEN CAST(l_orderkey AS VARCHAR) END AS win, CASE WHEN l_linenumber < 6 THEN l_returnflag END AS attribute, CASE WHEN l_linenumber < 6 THEN l_linenumber END AS idx,
CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.0 END AS score, l_partkey AS part, l_suppkey AS supplier FROM lineitem""")
def statement_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of three parts taken apart, any model's name cut; other ids have none.  Verdicts scored by a table."""
    whole = F.concat_ws("|", "l_orderkey", "l_returnflag", F.concat(F.col("l_linenumber").cast("string"), F.lit("@model-1")))
    id_ = R.split_id(F.when(F.col("l_linenumber") < 6, whole).otherwise(F.concat_ws("|", "l_orderkey", "l_returnflag")))
    return table(spark, d, "lineitem").select(id_.alias("i"), R.value_of(F.col("l_returnflag"), {"A": 1.0, "R": 0.0}).alias("score"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).select(F.col("i.window").alias("win"), "i.attribute", "i.idx", "score", "part", "supplier")


@query("""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS path FROM pages), s AS (SELECT *, CASE page_id % 5 WHEN 0 THEN 'live' WHEN 1 THEN 'dead' WHEN 2 THEN 'dead' ELSE 'unknown' END AS state FROM p)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https:' || regexp_extract(url, '//.*$', 0) WHEN 2 THEN CASE WHEN starts_with(path, '/') THEN 'https://base.example.org' || path ELSE 'https://base.example.org/' || path END ELSE 'https://base.example.org/x/' || page_id END AS target,
state, CASE WHEN state = 'dead' THEN 'https://web.archive.org/web/2/' || url ELSE url END AS reachable FROM s""")
def page_targets(spark: SparkSession, d: str) -> DataFrame:
    """Links made absolute, the state of pages by their status, and archived copies of the dead ones."""
    k, url = F.col("page_id"), F.col("url")
    path = F.regexp_extract(url, "^https?://[^/]+(.*)$", 1)
    href = _pick(k, url, F.regexp_extract(url, "//.*$", 0), path, F.concat(F.lit("x/"), k.cast("string")))
    state = R.url_state(F.when(k % 5 == 0, 200).when(k % 5 == 1, 404).when(k % 5 == 2, 410).when(k % 5 == 3, 503))
    return table(spark, d, "pages").select("page_id", R.absolute_url(href, "https://base.example.org/").alias("target"), state.alias("state"), R.live_or_archived(url, state != "dead").alias("reachable"))


@query(f"""
WITH q AS (SELECT doc_id, {_KEY.format('text')} AS s, CASE doc_id % 3 WHEN 0 THEN substr(text, 11, 60) WHEN 1 THEN substr(text, 1, 40) || ' … ' || substr(text, 61, 40) ELSE 'zzqx ' || substr(text, 1, 30) END AS quote FROM documents),
k AS (SELECT doc_id, s, {_KEY.format('quote')} AS q FROM q), p AS (SELECT *, list_filter(list_transform(string_split(q, '...'), lambda x: trim(x, ' ')), lambda x: length(x) >= 25) AS parts FROM k)
SELECT doc_id, CASE WHEN contains(s, q) THEN 'verbatim' WHEN len(parts) > 0 AND len(list_filter(parts, lambda x: NOT contains(s, x))) = 0 AND contains(q, '...') THEN 'spliced' ELSE 'missing' END AS class FROM p""")
def quote_classes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a quote stands in its document as it is, in parts around an ellipsis, or not at all."""
    t = F.col("text")
    quote = _pick(F.col("doc_id"), F.substring(t, 11, 60), F.concat(F.substring(t, 1, 40), F.lit(" … "), F.substring(t, 61, 40)), F.concat(F.lit("zzqx "), F.substring(t, 1, 30)))
    return table(spark, d, "documents").select("doc_id", T.quote_class(quote, t).alias("class"))


@query("""
WITH h AS (SELECT doc_id, text, CASE WHEN length(text) <= 80 THEN length(text) WHEN contains(substr(text, 1, 80), ' ') THEN length(regexp_extract(substr(text, 1, 80), '(?s)^(.*) ', 1)) ELSE 80 END AS cut FROM documents)
SELECT doc_id, substr(text, 1, cut) AS lead, md5(ltrim(substr(text, cut + 1), ' ')) AS rest FROM h""")
def text_leads(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at the last space of the first 80 characters, and a digest of the rest."""
    return table(spark, d, "documents").select("doc_id", R.lead_and_rest(F.col("text"), 80).alias("p")).select("doc_id", "p.lead", F.md5("p.rest").alias("rest"))


@query("SELECT c_custkey AS id, c_name AS title, c_mktsegment AS segment, 'http://x.example.org/y:z' AS link, CASE WHEN contains(lower(c_mktsegment), 'house') THEN 'home' WHEN contains(lower(c_mktsegment), 'auto') THEN 'car' END AS keyword FROM customer")
def note_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields at the heads of notes, and the first keyword that a field holds."""
    note = F.concat(F.lit("---\ntitle: "), F.col("c_name"), F.lit("\nsegment: "), F.col("c_mktsegment"), F.lit("\nlink: http://x.example.org/y:z\n---\nBody: text"))
    notes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), R.front_matter(note).alias("m"))
    return notes.select("id", F.col("m.title").alias("title"), F.col("m.segment").alias("segment"), F.col("m.link").alias("link"), R.first_keyword(F.col("m.segment"), [("HOUSE", "home"), ("auto", "car")]).alias("keyword"))


@query("""
SELECT o_orderkey AS id, o_orderkey % 5 <> 4 AS pending, 'Priority: ' || o_orderpriority || CASE o_orderkey % 5 WHEN 2 THEN chr(10) || chr(10) || 'Reply: Reply due 3 May' WHEN 3 THEN chr(10) || chr(10) || 'Reply: This question has been formally transferred' WHEN 4 THEN chr(10) || chr(10) || 'Reply: Yes, on ' || o_orderpriority ELSE '' END AS prompt FROM orders""")
def pending_replies(spark: SparkSession, d: str) -> DataFrame:
    """Which replies are still due, and records as labelled text without the missing parts."""
    k = F.col("o_orderkey")
    reply = _pick(k, F.lit(None).cast("string"), "  ", "Reply due 3 May", "This question has been formally transferred", F.concat(F.lit("Yes, on "), F.col("o_orderpriority")))
    return table(spark, d, "orders").select(k.alias("id"), R.is_pending(reply).alias("pending"), R.labelled([("Priority", F.col("o_orderpriority")), ("Reply", reply)]).alias("prompt"))


@query("SELECT s_suppkey AS id, s_suppkey % 3 <> 2 AS same, CASE s_suppkey % 3 WHEN 0 THEN lower(s_name) WHEN 1 THEN 'jo ' || lower(s_name) ELSE 'jo bloggs' END AS bare FROM supplier")
def same_people(spark: SparkSession, d: str) -> DataFrame:
    """Whether a mention with titles is the person of a name: by the whole name or by the surname."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    mention = _pick(k, F.concat(F.lit("Rt Hon Dr "), F.upper(name)), F.concat(F.lit("Dr Jo "), name), "Mrs Jo Bloggs")
    return table(spark, d, "supplier").select(k.alias("id"), R.same_person(mention, name).alias("same"), R.without_honorifics(mention).alias("bare"))


@query("""
WITH p AS (SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') || ' Bill' AS bill FROM part),
k AS (SELECT id, CASE WHEN id % 12 IN (0, 1, 2, 3) THEN bill END AS bill, ['first_reading', 'second_reading', 'third_reading', 'committee_report', 'closure', 'closure', 'urgency', 'amendment', 'committee', 'motion', 'urgency', 'other'][id % 12 + 1] AS kind FROM p)
SELECT id, kind, kind IN ('first_reading', 'second_reading', 'third_reading', 'committee', 'amendment', 'motion') AS substantive, bill, ['passed', 'failed', 'passed', NULL][id % 4 + 1] AS verdict FROM k""")
def question_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of questions, which of them decide something, the bills they name and how they ended."""
    k, bill = F.col("p_partkey"), F.concat(F.lit("That the "), F.initcap("p_name"), F.lit(" Bill be "))
    ends = ("now read a first time", "now read a second time", "now read a third time", "reported to the House by 1 December")
    others = ("That debate on this question now close", "That the question be now put", "That urgency be accorded", "That the amendments in clause 4 be agreed to", "That Part 1 as amended be agreed to", "That the motion be agreed to", "That the extended sitting begin", "That leave be granted for something unusual")
    question = _pick(k, *(F.concat(bill, F.lit(e)) for e in ends), *others)
    said = _pick(k, "Motion agreed to.", "Motion not agreed to.", "Bill read a third time.", "The House rose at ten.")
    rows = table(spark, d, "part").select(k.alias("id"), question.alias("q"), said.alias("s"))
    kind = parsers.question_type(F.col("q"))
    return rows.select("id", kind.alias("kind"), kind.isin(*parsers.SUBSTANTIVE).alias("substantive"), parsers.bill_title(F.col("q")).alias("bill"), parsers.verdict(F.col("s")).alias("verdict"))


@query("""
WITH v AS (SELECT s_suppkey AS day, s_suppkey % 40 + 1 AS a, s_suppkey % 11 + 3 AS b, s_suppkey % 17 + 2 AS c, s_suppkey % 5 = 0 AS wrong, s_suppkey % 3 = 2 AS bare FROM supplier)
SELECT day, CAST(a + b + 2 AS INTEGER) AS ayes, CAST(c + 9 AS INTEGER) AS noes, CASE WHEN a + b + 2 > c + 9 THEN 'passed' ELSE 'failed' END AS result, array_to_string(list_filter([CASE WHEN wrong AND NOT bare THEN 'ayes_total_mismatch' END, CASE WHEN a + b + 2 <= c + 9 THEN 'verdict_mismatch' END], lambda x: x IS NOT NULL), ' ') AS flags FROM v""")
def vote_records(spark: SparkSession, d: str) -> DataFrame:
    """Votes read from transcript lines: tallies that run over lines, with and without labels, and what disagrees."""
    k = F.col("s_suppkey")
    a, b, c = k % 40 + 1, k % 11 + 3, k % 17 + 2
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    labelled = k % 3 != 2
    lines = F.array(
        F.lit("A party vote was called for on the question, That the Clean Rivers Bill be now read a second time."),
        F.when(labelled, text("Ayes ", a + b + 2 + (k % 5 == 0).cast("int"))), F.when(labelled, text("North Party ", a, "; East Party")).otherwise(text("North Party ", a, "; East Party ", b, "; Independents: Lowe, Park 2.")),
        F.when(labelled, text(b, "; Independents: Lowe, Park 2.")), F.when(labelled, text("Noes ", c + 9)), text("South Party ", c, "; Tide 9."), F.lit("Motion agreed to."),
    )
    rows = table(spark, d, "supplier").select(k.alias("day"), F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("ord", "line"))
    found = parsers.divisions(rows, ["day"])
    return found.select("day", F.col("ayes.total").alias("ayes"), F.col("noes.total").alias("noes"), "result", F.array_join("flags", " ").alias("flags"))


@query("""
WITH c AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'checked' WHEN 1 THEN 'reported' WHEN 2 THEN 'guess' END AS class FROM supplier)
SELECT id, class, coalesce(class IN ('checked', 'reported'), false) AS settled FROM c""")
def note_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class that each note begins with, and whether it is one of the settled ones."""
    k = F.col("s_suppkey")
    note = _pick(k, F.concat(F.lit("Checked; see "), k.cast("string"), F.lit("; twice")), " reported ", "GUESS;none", "; no class")
    rows = table(spark, d, "supplier").select(k.alias("id"), R.leading_class(note).alias("class"))
    return rows.withColumn("settled", F.coalesce(F.col("class").isin("checked", "reported"), F.lit(False)))


@query("""
WITH k AS (SELECT DISTINCT l_returnflag || l_linestatus || (l_suppkey % 3) AS attr, l_partkey AS key FROM lineitem), n AS (SELECT attr, count(*) AS n FROM k GROUP BY 1),
j AS (SELECT a.attr AS a, b.attr AS b, count(*) AS n_both FROM k a JOIN k b ON a.key = b.key AND a.attr < b.attr GROUP BY 1, 2)
SELECT a, b, n_both, round(n_both / (na.n + nb.n - n_both)::DOUBLE, 10) AS jaccard FROM j JOIN n na ON na.attr = a JOIN n nb ON nb.attr = b ORDER BY jaccard DESC, a, b LIMIT 5""")
def top_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """The five pairs of attributes that share most of their keys."""
    attr = F.concat("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 3).cast("string"))
    k = table(spark, d, "lineitem").select(attr.alias("attr"), F.col("l_partkey").alias("key")).distinct()
    attrs = k.groupBy("key").agg(F.sort_array(F.collect_set("attr")).alias("attrs"))  # a key has as many attributes as there are, a few
    pairs = attrs.select(F.explode("attrs").alias("a"), "attrs").select("a", F.explode(F.filter("attrs", lambda x: x > F.col("a"))).alias("b"))
    n = k.groupBy("attr").agg(F.count("*").alias("n"))
    j = pairs.groupBy("a", "b").agg(F.count("*").alias("n_both"))
    j = j.join(n.select(F.col("attr").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("attr").alias("b"), F.col("n").alias("nb")), "b")
    share = F.round(F.col("n_both") / (F.col("na") + F.col("nb") - F.col("n_both")), 10)
    return j.select("a", "b", "n_both", share.alias("jaccard")).orderBy(F.desc("jaccard"), "a", "b").limit(5)
