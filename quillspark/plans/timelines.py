"""Queries along an order: the nearest row in time, numbered terms, votes of a day's lines, pieces of long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators import chunks, mentions, ordered, questions, votes
from quillspark.plans.registry import query, table


def _events(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type") == kind)


@query("""
WITH p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id, ts, max(event_id) AS error_id FROM events WHERE event_type = 'error' GROUP BY ALL), c AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT p.event_id, e.error_id, epoch_us(p.ts) - epoch_us(e.ts) AS since_error_us, c.click_id, epoch_us(c.ts) - epoch_us(p.ts) AS to_click_us
FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.ts >= e.ts ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts <= c.ts""")
def events_around_purchases(spark: SparkSession, d: str) -> DataFrame:
    """For every purchase its user's last error before and first click after it."""
    errors, clicks = (_events(spark, d, k).select("user_id", F.col("ts").alias(at), F.col("event_id").alias(i)) for k, at, i in (("error", "error_at", "error_id"), ("click", "click_at", "click_id")))
    p = ordered.asof_join(_events(spark, d, "purchase"), errors, ["user_id"], "ts", "error_at", ["error_id"])
    p = ordered.asof_join(p, clicks, ["user_id"], "ts", "click_at", ["click_id"], "forward")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return p.select("event_id", "error_id", (us("ts") - us("error_at")).alias("since_error_us"), "click_id", (us("click_at") - us("ts")).alias("to_click_us"))


@query("""
WITH s AS (SELECT o_orderdate AS taken, max(o_orderkey) AS snapshot FROM orders WHERE o_orderkey % 4 = 1 GROUP BY 1), o AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 4 <> 1),
b AS (SELECT o.*, s.taken AS b_at, s.snapshot AS b FROM o ASOF LEFT JOIN s ON o.o_orderdate >= s.taken), n AS (SELECT b.*, s.taken AS a_at, s.snapshot AS a FROM b ASOF LEFT JOIN s ON b.o_orderdate <= s.taken),
m AS (SELECT o_orderkey, o_orderdate, CASE WHEN b_at IS NOT NULL AND (a_at IS NULL OR o_orderdate - b_at <= a_at - o_orderdate) THEN struct_pack(at := b_at, id := b) ELSE struct_pack(at := a_at, id := a) END AS m FROM n)
SELECT o_orderkey, CASE WHEN abs(epoch(m.at) - epoch(o_orderdate)) <= 172800 THEN m.id END AS snapshot FROM m""")
def nearest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """For every order the snapshot (of every fourth order) nearest to its date, if within two days."""
    o = table(spark, d, "orders")
    taken = o.where("o_orderkey % 4 = 1").select(F.col("o_orderdate").alias("taken"), F.col("o_orderkey").alias("snapshot"))
    near = F.abs(F.unix_seconds(F.col("taken").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))) <= 2 * 86400
    return ordered.asof_join(o.where("o_orderkey % 4 <> 1"), taken, [], "o_orderdate", "taken", ["snapshot"], "nearest", within=near).select("o_orderkey", "snapshot")


@query("""
WITH t AS (SELECT begins, CAST(row_number() OVER (ORDER BY begins) AS INTEGER) AS number FROM (SELECT max(o_orderdate) AS begins FROM orders GROUP BY year(o_orderdate))),
l AS (SELECT l_shipdate, l_linestatus, l_quantity FROM lineitem)
SELECT number, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM l ASOF LEFT JOIN t ON l.l_shipdate >= t.begins GROUP BY 1, 2""")
def lines_by_term(spark: SparkSession, d: str) -> DataFrame:
    """Lines counted by the number of the term that runs when they ship (terms begin with a year's last order)."""
    begins = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.max("o_orderdate").alias("begins"))
    terms = begins.select("begins", F.row_number().over(Window.orderBy("begins")).alias("number"))  # a row a year
    found = ordered.numbered_at(table(spark, d, "lineitem").select("l_shipdate", "l_linestatus", "l_quantity"), "l_shipdate", terms, "begins", "number")
    return found.groupBy("number", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


#: Parties of the transcripts below, as they are written, and their short names.
PARTIES = {"North Alliance": "north", "South Union": "south", "Union of the South": "south", "Tide": "tide"}


def transcript_lines(spark: SparkSession, d: str) -> DataFrame:
    """``conv_id, ord, line``: each conversation's lines as a day's transcript.

    What a line becomes is read from it: its length picks calls, labels and tallies, whose
    numbers are its length and its words, whose members and bills its first word; the rest stays prose.
    """
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    n, word = F.length("line"), F.regexp_extract("line", r"^(\p{Lu}\p{L}{1,20})", 1)
    words = F.size(F.split("line", " "))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    shapes: list[Column] = [
        text("A party vote was called for on the question, That the ", word, " Bill be now read a second time ."),
        text("A party vote was called for on the question, That the motion be agreed to."),
        text("Ayes ", n % 40 + words), text("Noes ", n % 40 + words), text("North Alliance ", n % 40, "; Tide ", words, "."), text("South Union ", n % 40, "; Union of the South ", words, "; ", word, "."),
        text("Tide ", n % 40 + words), text("Abstentions ", words), text("Motion agreed to."),
    ]
    shaped = F.get(F.array(*shapes), ((n + words) % 12).cast("int"))
    return lines.select("conv_id", (F.col("turn") * 1_000_000 + F.col("i")).alias("ord"), F.coalesce(shaped, F.col("line")).alias("line"))


@query(r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
f AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS pos, line, length(line) AS n, len(string_split(line, ' ')) AS words, regexp_extract(line, '^(\p{Lu}\p{L}{1,20})', 1) AS word FROM raw),
l AS (SELECT conv_id, pos, (n + words) % 12 AS kind, n % 40 AS a, words AS w, word, line FROM f),
c AS (SELECT conv_id, pos, kind, line, word, word <> '' AND word <> 'Tide' AS named,
    CASE WHEN kind = 2 THEN 'ayes' WHEN kind = 3 THEN 'noes' WHEN kind = 7 THEN 'abstentions' END AS side, CASE WHEN kind IN (2, 3) THEN a + w WHEN kind = 7 THEN w END AS declared,
    kind IN (4, 6) OR (kind = 5) AS is_tally, CASE kind WHEN 4 THEN a + w WHEN 5 THEN a + w + (word <> '')::INT WHEN 6 THEN a + w ELSE 0 END AS votes, kind IN (4, 5) AS stop FROM l),
v AS (SELECT conv_id, pos AS call_pos, pos, NULL::VARCHAR AS pending, NULL::BIGINT AS declared, 0::BIGINT AS open, false AS is_open, 0 AS n, []::STRUCT(side VARCHAR, declared BIGINT, votes BIGINT)[] AS sides, 0 AS taken FROM c WHERE kind IN (0, 1)
  UNION ALL
  SELECT v.conv_id, v.call_pos, c.pos, CASE WHEN c.side IS NOT NULL THEN c.side WHEN NOT x.closed THEN v.pending END, CASE WHEN c.side IS NOT NULL THEN c.declared WHEN NOT x.closed THEN v.declared END,
    CASE WHEN x.closed THEN 0 WHEN c.is_tally THEN v.open + c.votes ELSE v.open END, CASE WHEN x.closed THEN false ELSE v.is_open OR c.is_tally END, v.n + x.closed::INT,
    CASE WHEN x.closed THEN list_append(v.sides, struct_pack(side := coalesce(v.pending, ['ayes', 'noes', 'abstentions'][v.n + 1]), declared := v.declared, votes := v.open + c.votes)) ELSE v.sides END, CASE WHEN c.is_tally THEN c.pos - v.call_pos ELSE v.taken END
  FROM v JOIN c ON c.conv_id = v.conv_id AND c.pos = v.pos + 1, LATERAL (SELECT c.is_tally AND (c.stop OR coalesce(v.open + c.votes >= v.declared, false)) AS closed) x
  WHERE (c.side IS NOT NULL AND v.pending IS NULL AND NOT v.is_open) OR (c.is_tally AND NOT (x.closed AND v.pending IS NULL AND v.n >= 3))),
e AS (SELECT conv_id, call_pos, arg_max(sides, pos) AS sides, arg_max(taken, pos) AS taken FROM v GROUP BY ALL),
s AS (SELECT e.*, list_filter(sides, lambda s: s.side = 'ayes')[-1] AS ayes, list_filter(sides, lambda s: s.side = 'noes')[-1] AS noes, list_filter(sides, lambda s: s.side = 'abstentions')[-1] AS abst, c.kind AS kind, c.word AS word, row_number() OVER (PARTITION BY e.conv_id ORDER BY call_pos) AS k,
    coalesce((SELECT x.kind = 8 FROM c x WHERE x.conv_id = e.conv_id AND x.pos = e.call_pos + e.taken + 1), false) AS said FROM e JOIN c ON c.conv_id = e.conv_id AND c.pos = e.call_pos),
b AS (SELECT *, CASE WHEN kind = 0 THEN CASE word WHEN '' THEN 'the' ELSE word END || ' Bill' END AS own FROM s),
r AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY call_pos) AS bill, CASE WHEN ayes IS NOT NULL THEN ayes.votes > coalesce(noes.votes, 0) END AS agreed FROM b)
SELECT conv_id || '-' || lpad(k::VARCHAR, 3, '0') AS division_id, CASE kind WHEN 0 THEN 'second_reading' ELSE 'motion' END AS type, bill, CASE WHEN own IS NOT NULL THEN 'question' WHEN bill IS NOT NULL THEN 'carried_forward' END AS bill_source,
  ayes.votes::INT AS ayes, ayes.declared::INT AS ayes_declared, noes.votes::INT AS noes, abst.votes::INT AS abstentions, CASE WHEN agreed IS NOT NULL THEN CASE WHEN agreed THEN 'agreed' ELSE 'not_agreed' END WHEN said THEN 'agreed' END AS result,
  array_to_string(list_filter([CASE WHEN len(sides) = 0 THEN 'no_vote_lines' END, CASE WHEN ayes.votes <> ayes.declared OR noes.votes <> noes.declared OR abst.votes <> abst.declared THEN 'tally_mismatch' END, CASE WHEN len(sides) > 0 THEN CASE WHEN len(list_filter(sides, lambda s: s.declared IS NOT NULL)) > 0 THEN 'ayes_labelled' ELSE 'ayes_order_inferred' END END,
    CASE WHEN ayes IS NOT NULL AND noes IS NULL THEN 'unopposed' END, CASE WHEN NOT said AND agreed IS NOT NULL THEN 'result_from_totals' END, CASE WHEN said AND NOT agreed THEN 'verdict_conflicts_with_totals' END], lambda x: x IS NOT NULL), ' ') AS flags FROM r""")
def division_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes found in the conversations' lines, with totals, results and what disagrees."""
    found = votes.division_records(transcript_lines(spark, d), ["conv_id"], "ord", "line", PARTIES)
    return found.select("division_id", "type", F.get("bills", F.lit(0)).alias("bill"), "bill_source", F.col("ayes.total").alias("ayes"), F.col("ayes.declared_total").alias("ayes_declared"), F.col("noes.total").alias("noes"), F.col("abstentions.total").alias("abstentions"), "result", F.array_join("flags", " ").alias("flags"))


@query(r"""
WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
s AS (SELECT doc_id, p, 0 AS i, '' AS open, []::VARCHAR[] AS out FROM p
  UNION ALL SELECT doc_id, p, i + 1, substr(b, 500 * k + 1), list_concat(CASE WHEN closes THEN [open] ELSE [] END, list_transform(range(k), lambda x: substr(b, 500 * x + 1, 500)))
  FROM (SELECT *, greatest(0, (length(b) - 1) // 500) AS k FROM (SELECT *, CASE WHEN closes OR open = '' THEN p[i + 1] ELSE open || chr(10) || p[i + 1] END AS b FROM (SELECT *, open <> '' AND length(open) + length(p[i + 1]) + 1 > 500 AS closes FROM s WHERE i < len(p))))),
o AS (SELECT doc_id, i, unnest(out) AS text, generate_subscripts(out, 1) AS j FROM s UNION ALL SELECT doc_id, i + 1, open, 1 FROM s WHERE i = len(p) AND regexp_matches(open, '\S'))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS chunk, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS sha FROM o""")
def paragraph_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Texts in pieces of at most 500 characters: whole paragraphs where they fit, long ones divided."""
    found = chunks.paragraph_chunks(table(spark, d, "documents"), "doc_id", "text", 500)
    return found.select("doc_id", "chunk", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha"))


@query("""
WITH RECURSIVE l AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS o, CAST(sum(l_quantity) AS BIGINT) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS i FROM lineitem GROUP BY 1, 2),
s AS (SELECT k, o, n, i, CAST(0 AS BIGINT) AS w, CAST(0 AS BIGINT) AS before FROM l WHERE i = 1
  UNION ALL SELECT l.k, l.o, l.n, l.i, x.w + CASE WHEN x.f > 0 AND x.f + l.n > 30 THEN 1 ELSE 0 END, CASE WHEN x.f > 0 AND x.f + l.n > 30 THEN 0 ELSE x.f END
  FROM s JOIN l ON l.k = s.k AND l.i = s.i + 1, LATERAL (SELECT s.w + CASE WHEN s.before = 0 THEN greatest(0, (s.n - 1) // 30) ELSE 0 END AS w, CASE WHEN s.before + s.n <= 30 THEN s.before + s.n ELSE s.n - (s.n - 1) // 30 * 30 END AS f) x)
SELECT k AS supplier, o AS line, w + j AS window, 30 * j AS start, least(n - 30 * j, 30) AS length FROM (SELECT *, unnest(range(greatest(1, (n + 29) // 30))) AS j FROM s)""")
def divided_batches(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's lines packed into loads of at most 30 units, larger lines divided."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")).agg(F.sum("l_quantity").cast("bigint").alias("n"))
    return chunks.divide(lines, ["supplier"], "line", "n", 30)


@query(r"""
WITH a AS (SELECT item_id, string_split_regex(regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g'), '[ \t\n\r\f]+') AS w FROM benchmark), n AS (SELECT item_id, array_to_string(w[1:3], ' ') AS full_name, list_filter(w, lambda x: regexp_full_match(x, '[a-z]{7,}'))[1] AS surname FROM a),
d AS (SELECT doc_id, regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g') AS t, source AS author FROM documents)
SELECT doc_id, item_id, CASE WHEN contains(t, full_name) OR contains(lower(author), full_name) THEN 'name' ELSE 'surname' END AS via FROM d, n
WHERE contains(t, full_name) OR contains(lower(author), full_name) OR (surname IS NOT NULL AND contains(t, surname) AND regexp_matches(t, '\b' || surname || '\b'))""")
def alias_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Documents that mention an item by its first three words, or else by its first long word as a whole word."""
    w = F.split("text", r"[ \t\n\r\f]+")
    items = table(spark, d, "benchmark").select("item_id", mentions.folded_text(F.col("text")).alias("text"))  # a word is long by the letters that folding leaves
    full = items.select("item_id", F.array_join(F.slice(w, 1, 3), " ").alias("alias"), F.lit(False).alias("is_surname"))
    last = items.select("item_id", F.get(F.filter(w, lambda x: x.rlike(r"^[a-z]{7,}\z")), F.lit(0)).alias("alias"), F.lit(True).alias("is_surname"))
    return mentions.find_mentions(table(spark, d, "documents"), "doc_id", ["text", "source"], full.unionByName(last), "item_id", "alias", "is_surname")


@query(r"""
WITH t AS (SELECT conv_id, turn, role, string_split(text, chr(10))[1] AS said, length(text) AS n, conv_id // 10 AS day FROM conversations),
f AS (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS p FROM t), q AS (SELECT conv_id, said AS opening FROM f WHERE turn = p),
r AS (SELECT f.*, q.opening, CASE WHEN role = 'assistant' THEN 'a' WHEN role = 'user' AND NOT n % 9 = 0 THEN 'q' END AS kind FROM f JOIN q USING (conv_id) WHERE turn > p AND trim(said) <> ''),
k AS (SELECT *, lag(kind) OVER w AS before, lag(said) OVER w AS last, sum((kind = 'q')::INT) OVER w AS asked FROM r WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, arg_min(role, turn) AS opens FROM r WHERE role IN ('user', 'assistant') GROUP BY 1),
x AS (SELECT k.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM k JOIN s USING (conv_id) WHERE opens = 'assistant' AND kind = 'a' AND (before IS NULL OR before = 'q'))
SELECT day || '-b' || lpad(dense_rank() OVER (PARTITION BY day ORDER BY conv_id)::VARCHAR, 2, '0') || '-' || i AS question_id, CAST(conv_id AS INTEGER) AS number, 'Ann Lee' AS asker, 'Bob Park-Hill' AS responder, trim(coalesce(last, opening)) AS question, trim(said) AS answer, CASE WHEN i > 0 THEN CAST(asked AS INTEGER) END AS supplementary_index FROM x""")
def oral_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions and answers read from transcripts of the conversations, ten a day: users ask, the assistant answers."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id")).alias("p")).where("turn >= p")
    opens = (F.col("role") == "user") & (F.col("turn") == F.col("p"))
    head = F.when(opens, F.concat(F.lit("Question No. "), "conv_id", F.lit("—Words\n1. Rt Hon ANN LEE (North—Hill) (14:44) to the Minister for Words: ")))
    tag = F.when(F.col("role") == "assistant", F.when(F.col("turn") % 4 == 1, "Hon BOB PARK-HILL (Minister for Words: All) : ").otherwise("Bob Park-Hill: ")).when(F.col("role") == "user", F.when(F.length("text") % 9 == 0, "Ann Lee: I seek leave ").otherwise("Hon Ann Lee: ")).otherwise(F.lit("SPEAKER: "))
    lines = c.select((F.col("conv_id") / 10).cast("bigint").alias("day"), "conv_id", "turn", F.posexplode(F.split(F.concat(F.coalesce(head, tag), "text"), "\n")).alias("i", "line"))
    ordered_ = lines.select("day", (F.col("conv_id") * 10_000_000_000 + F.col("turn") * 1_000_000 + F.col("i")).alias("ord"), "line")
    return questions.question_pairs(ordered_, ["day"], "ord", "line").select("question_id", "number", "asker", "responder", "question", "answer", "supplementary_index")
