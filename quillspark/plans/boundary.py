"""Queries of the boundary to outside judges: rescued replies, answers matched by id, stages that are stopped."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.json_rescue import rescued
from quillspark.operators import echoed
from quillspark.operators.ranking import shared_path
from quillspark.plans.registry import query, table
from quillspark.sources import listings
from quillspark.streaming import strikes


@query(r"""
WITH r AS (SELECT conv_id, turn, length(text) AS n, list_filter(string_split_regex(text, '[^\p{L}]+'), lambda w: w <> '') AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 = 4 AND len(w) < 2 THEN NULL WHEN n % 5 = 4 THEN 'cut' ELSE 'whole' END AS state,
  CAST(CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 = 4 THEN nullif(least(len(w), 6) - 1, 0) ELSE least(len(w), 6) END AS INTEGER) AS items,
  CASE WHEN n % 5 = 0 OR len(w) = 0 OR n % 5 = 4 AND len(w) < 2 THEN NULL ELSE w[1] END AS first_word FROM r WHERE len(w) > 0""")
def rescued_replies(spark: SparkSession, d: str) -> DataFrame:
    """Arrays found in replies made of each turn's own words: bare, fenced, in prose with brackets and quotes, cut off, or none."""
    words = F.slice(F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w != ""), 1, 6)
    array = F.to_json(F.transform(words, lambda w: F.struct(w.alias("word"), F.array(F.concat(w, F.lit('"]'))).alias("as_said"))))
    prose = F.regexp_replace(F.substring("text", 1, 80), "[\\[\\]{}]", "")
    cut = F.expr("substring(array, 1, length(array) - 5)")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"), words.alias("words"), array.alias("array"), prose.alias("prose")).where(F.size("words") > 0)
    shapes = [F.concat("prose", F.lit(" [no array")), F.col("array"), F.concat(F.lit("```json\n"), "array", F.lit("\n```\n"), "prose"), F.concat("prose", F.lit(' [sic], see [1], "as is": '), "array", F.lit(" and [2].")), F.concat(F.lit("So: "), cut)]
    replies = rows.withColumn("reply", F.get(F.array(*shapes), F.col("n") % 5))
    found = replies.select("conv_id", "turn", rescued(F.col("reply")).alias("r"))
    values = F.from_json("r.json", "array<struct<word:string>>")
    return found.select("conv_id", "turn", F.col("r.state").alias("state"), F.when(values.isNotNull(), F.size(values)).alias("items"), F.get(values, F.lit(0))["word"].alias("first_word"))


class LengthJudge:
    """A rule in the place of an outside judge: a text is long, short or (of an odd length) unclear.

    It answers in reverse order and in prose, and puts texts off to a second asking whose length is
    divisible by 4; those divisible by 12 it never answers from its vocabulary.
    """

    def __call__(self, questions: list[tuple[str, str]], again: int) -> str:
        answers = []
        for i, text in reversed(questions):
            n = len(text)
            if n % 12 == 0:
                answers.append({"id": i, "verdict": "no idea", "reason": ""})
            elif n % 4 or again:
                answers.append({"id": i, "verdict": "Unclear" if n % 2 else "long" if n > 150 else "short", "reason": str(n)})
        return f"[Verdicts] below\n```json\n{json.dumps(answers)}\n```"


@query("""
SELECT conv_id * 1000 + turn AS item, CASE WHEN n % 12 = 0 THEN NULL WHEN n % 2 = 1 THEN 'unclear' WHEN n > 150 THEN 'long' ELSE 'short' END AS verdict, CASE WHEN n % 12 <> 0 THEN n::VARCHAR END AS reason,
  CAST(CASE WHEN n % 12 = 0 THEN 3 WHEN n % 4 = 0 THEN 2 ELSE 1 END AS INTEGER) AS asks, CAST(CASE WHEN n % 12 = 0 THEN 3 ELSE 0 END AS INTEGER) AS refused, CASE WHEN n % 12 = 0 THEN 'unanswered' ELSE 'answered' END AS state
FROM (SELECT conv_id, turn, length(text) AS n FROM conversations)""")
def echoed_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on every turn, matched by the ids that a judge echoes; what it leaves open or says in other words is asked again."""
    items = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), "text")
    return echoed.ask(items, "item", "text", LengthJudge(), ["long", "short", "unclear"]).drop("doubled")


@query("""
WITH p AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS wrote, event_type = 'error' AS blocked FROM events), r AS (SELECT *, sum(wrote::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM p),
c AS (SELECT *, sum((blocked AND NOT wrote)::INT) OVER w AS q, sum((NOT blocked AND NOT wrote)::INT) OVER w AS i FROM r WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id)),
f AS (SELECT user_id, ts AS stop_at, CASE WHEN q >= 5 THEN 'quota' ELSE 'idle' END AS reason, 0 AS late FROM c WHERE q >= 5 OR i >= 6 UNION ALL
  SELECT user_id, ts + INTERVAL 36 HOURS, 'silence', 1 FROM c WHERE coalesce(next, (SELECT max(ts) FROM events)) >= ts + INTERVAL 36 HOURS AND (next IS NULL OR next > ts + INTERVAL 36 HOURS)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY stop_at, late, reason) AS n FROM f)
SELECT user_id, epoch_us(stop_at) AS at_us, reason FROM k WHERE n = 1""")
def stopped_stages(spark: SparkSession, d: str) -> DataFrame:
    """Where each user's log of events is stopped: by strikes in a row between purchases, or by 36 hours of silence."""
    passes = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") == "purchase").cast("int").alias("written"), (F.col("event_type") == "error").alias("blocked"))
    found = strikes.stops(passes, "user_id", "ts", "written", "blocked", "event_id", F.expr("INTERVAL 36 HOURS"))
    return found.select("user_id", F.unix_micros("at").alias("at_us"), "reason")


@query("""
WITH m AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS month FROM orders), p AS (SELECT *, CAST((row_number() OVER (PARTITION BY month ORDER BY o_orderkey) - 1) // 200 AS INTEGER) AS page FROM m),
l AS (SELECT min(month) AS first FROM m)
SELECT month, page, o_orderkey, o_orderstatus, o_totalprice FROM p, l WHERE month > first AND substr(month, 6) IN ('02', '07') AND page < 3""")
def listed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders laid out as a monthly listing of pages of 200, and the first three pages of two months of each year read back from it."""
    path = shared_path(spark, "listing")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    listings.write_listing(orders, path, F.date_format("o_orderdate", "yyyy-MM"), [F.col("o_orderkey")], 200)
    rows = listings.read_listing(spark, path)
    first = rows.where("page = 0").agg(F.min("month")).first()[0]
    months = [f"{int(first[:4]) + y}-{m}" for y in range(50) for m in ("02", "07")]
    found = rows.where(F.col("month").isin(months) & (F.col("month") > first) & (F.col("page") < 3))
    return found.select("month", "page", F.from_json("record", "o_orderkey bigint, o_orderstatus string, o_totalprice double").alias("r")).select("month", "page", "r.*")
