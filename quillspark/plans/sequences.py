"""Queries of ranking, sampling, segmentation and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators import incremental, packing, ranking, segments
from quillspark.plans.registry import query, table


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, event_type FROM e WHERE n <= 3 OR pos IN (0, n // 3, 2 * n // 3)""")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    """Up to three events of each user, evenly spread over time."""
    return ranking.stride_sample(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 3).select("user_id", "event_id", "event_type")


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), b AS (SELECT doc_id, substr(h, 1, 16) AS content_id, list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(h, i, 1)) - 1) * CAST(pow(16, 8 - i) AS BIGINT))) % 1000 AS bucket FROM h)
SELECT doc_id, content_id, CAST(bucket AS BIGINT) AS bucket, CASE WHEN bucket < 800 THEN 'train' WHEN bucket < 900 THEN 'dev' ELSE 'test' END AS split FROM b""")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """Content-addressed ids and splits."""
    bucket = T.hash_bucket(F.col("text"), 1000)
    return table(spark, d, "documents").select("doc_id", T.score_key(F.col("text")).alias("content_id"), bucket.alias("bucket"), F.when(bucket < 800, "train").when(bucket < 900, "dev").otherwise("test").alias("split"))


@query("""
WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('s7' || doc_id::VARCHAR), doc_id) AS turn FROM documents)
SELECT doc_id, lang, source, turn FROM r ORDER BY turn, lang, source LIMIT 60""")
def round_robin_strata(spark: SparkSession, d: str) -> DataFrame:
    """Sixty documents in turns over language and source (a sampling operator)."""
    return ranking.round_robin(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", "s7", 60)


@query("""
WITH a AS (SELECT doc_id, source, sha256(text) AS content, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE n_chars > 200),
b AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS pos FROM a WHERE rn <= 5), c AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id) AS k FROM b WHERE pos <= 80)
SELECT doc_id, source, rn FROM c WHERE k = 1""")
def first_n_per_author(spark: SparkSession, d: str) -> DataFrame:
    """The first five documents of each source, at most 80 in all, without repeated texts."""
    a = table(spark, d, "documents").where("n_chars > 200").select("doc_id", "source", F.sha2("text", 256).alias("content"))
    b = a.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("rn <= 5").orderBy("doc_id").limit(80)
    return ranking.first_rows(b, ["content"], [F.col("doc_id")]).select("doc_id", "source", "rn")


@query("""
WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_discount, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC NULLS LAST, l_orderkey, l_linenumber) - 1 AS pos, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
w AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i)
SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_discount FROM r, w WHERE n <= 6 OR pos = round_even(i * (n - 1) / 5.0, 0)""")
def spread_pick(spark: SparkSession, d: str) -> DataFrame:
    """Six examples of each supplier, from its highest score to its lowest."""
    return ranking.spread_pick(table(spark, d, "lineitem"), ["l_suppkey"], [F.col("l_discount").desc_nulls_last(), F.col("l_orderkey"), F.col("l_linenumber")], 6).select("l_suppkey", "l_orderkey", "l_linenumber", "l_discount")


@query("""
WITH r AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
SELECT p_partkey, p_retailprice, rank, CASE WHEN rank <= 1 THEN 'legendary' WHEN rank <= 3 THEN 'epic' WHEN rank <= 7 THEN 'rare' WHEN rank <= 15 THEN 'uncommon' ELSE 'common' END AS rarity FROM r""")
def rarity_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Rarity by rank in buckets of 1, 2, 4, 8 and the rest."""
    r = ranking.global_row_number(table(spark, d, "part").select("p_partkey", "p_retailprice"), [F.col("p_retailprice").desc(), F.col("p_partkey").asc()])
    k = F.col("rank")
    return r.withColumn("rarity", F.when(k <= 1, "legendary").when(k <= 3, "epic").when(k <= 7, "rare").when(k <= 15, "uncommon").otherwise("common"))


@query("""
SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d') || '-' || lpad(row_number() OVER w::VARCHAR, 3, '0') AS seq_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS context FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)""")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Context that holds until it is replaced or the day ends, and numbers within the day."""
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    keys, order = ["user_id", "day"], [F.col("ts"), F.col("event_id")]
    context = segments.carry_forward(F.when(F.col("event_type") == "signup", F.col("event_id")), keys, order)
    return e.select("event_id", "user_id", "day", segments.sequence_id(F.col("day"), keys, order).alias("seq_id"), context.alias("context"))


@query("""
WITH a AS (SELECT user_id, row_number() OVER w AS pos, event_type = 'error' AS rs, CASE WHEN event_type = 'error' THEN '' WHEN event_type <> 'view' THEN event_type END AS named FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CASE WHEN rs THEN NULL ELSE nullif(last_value(named IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING), '') END AS speaker FROM a),
c AS (SELECT *, CASE WHEN rs OR speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY user_id ORDER BY pos) THEN 1 ELSE 0 END AS ch FROM b), e AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY run) AS block, speaker, count(*) AS n, min(pos) AS first_at, max(pos) AS last_at FROM e WHERE speaker IS NOT NULL GROUP BY user_id, run, speaker""")
def speaker_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one speaker: views are untagged turns, errors are procedure that cuts."""
    kind = F.col("event_type")
    return segments.speaker_blocks(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.when(kind != "view", kind), kind == "error")


@query("""
WITH s AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS q, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS i FROM conversations WHERE role IN ('user', 'assistant')),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY turn) AS rn FROM s WHERE role = 'assistant' AND q IS NOT NULL)
SELECT conv_id, q AS question, turn AS answer, CAST(i AS INTEGER) AS supplementary FROM a WHERE rn = 1""")
def qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each answer with the latest open question."""
    return segments.pair_answers(table(spark, d, "conversations"), ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "assistant")


@query("""
WITH RECURSIVE i AS (SELECT doc_id // 500 AS day, doc_id, n_chars // 4 AS size, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS pos FROM documents),
w AS (SELECT day, doc_id, pos, size AS total, 0 AS wn FROM i WHERE pos = 1
  UNION ALL SELECT i.day, i.doc_id, i.pos, CASE WHEN w.total + i.size > 3000 THEN i.size ELSE w.total + i.size END, CASE WHEN w.total + i.size > 3000 THEN w.wn + 1 ELSE w.wn END FROM w JOIN i ON i.day = w.day AND i.pos = w.pos + 1)
SELECT day, doc_id, CAST(wn AS INTEGER) AS "window" FROM w""")
def greedy_windows(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a block of ids (a day) packed into windows of about 3,000 tokens."""
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 500).alias("day"), "doc_id", "n_chars")
    return packing.pack(docs, ["day"], "doc_id", packing.token_estimate(F.col("n_chars")), 3000)


@query("""
WITH RECURSIVE i AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
w AS (SELECT conv_id, turn, pos, size AS total, 1 AS n, 0 AS wn FROM i WHERE pos = 1
  UNION ALL SELECT i.conv_id, i.turn, i.pos, CASE WHEN w.total + i.size > 400 OR w.n >= 3 THEN i.size ELSE w.total + i.size END, CASE WHEN w.total + i.size > 400 OR w.n >= 3 THEN 1 ELSE w.n + 1 END, CASE WHEN w.total + i.size > 400 OR w.n >= 3 THEN w.wn + 1 ELSE w.wn END FROM w JOIN i ON i.conv_id = w.conv_id AND i.pos = w.pos + 1)
SELECT conv_id, turn, CAST(wn AS INTEGER) AS "window" FROM w""")
def greedy_batches(spark: SparkSession, d: str) -> DataFrame:
    """Turns in batches of at most three and about 400 characters."""
    return packing.pack(table(spark, d, "conversations"), ["conv_id"], "turn", F.length("text"), 400, 3)


@query("""
WITH h AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error'), r AS (SELECT user_id, min(d) AS a, max(d) AS b FROM h GROUP BY 1),
c AS (SELECT user_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM r)
SELECT user_id, strftime(c.d, '%Y-%m-%d') AS missing_day, CAST(week(c.d) AS INTEGER) AS iso_week FROM c ANTI JOIN h USING (user_id, d) WHERE isodow(c.d) IN (2, 3, 4)
  AND EXISTS (SELECT 1 FROM h x WHERE x.user_id = c.user_id AND x.d < c.d AND date_trunc('week', x.d) = date_trunc('week', c.d)) AND EXISTS (SELECT 1 FROM h x WHERE x.user_id = c.user_id AND x.d > c.d AND date_trunc('week', x.d) = date_trunc('week', c.d))""")
def sitting_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Tuesdays to Thursdays without an entry that entries of the same week enclose."""
    have = table(spark, d, "events").where("event_type = 'error'").select("user_id", F.to_date("ts").alias("d")).distinct()
    weeks = have.groupBy("user_id", F.date_trunc("week", "d").alias("wk")).agg(F.min("d").alias("a"), F.max("d").alias("b"), F.collect_set("d").alias("days"))  # seven days at most
    between = F.filter(F.sequence("a", "b"), lambda x: F.weekday(x).isin(1, 2, 3) & ~F.array_contains(F.col("days"), x))
    return weeks.select("user_id", F.explode(between).alias("m")).select("user_id", F.date_format("m", "yyyy-MM-dd").alias("missing_day"), F.weekofyear("m").alias("iso_week"))


@query("""
SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW), 6) AS spent_5h, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND CURRENT ROW), 6) AS spent_7d,
 sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW) <= 200 AND sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND CURRENT ROW) <= 600 AS allowed FROM events""")
def rolling_budget(spark: SparkSession, d: str) -> DataFrame:
    """Spending in trailing windows of five hours and seven days, and whether both budgets hold."""
    e = incremental.rolling_sums(table(spark, d, "events"), ["user_id"], "ts", "value", {"spent_5h": 5, "spent_7d": 168})
    return e.select("event_id", "user_id", F.round("spent_5h", 6).alias("spent_5h"), F.round("spent_7d", 6).alias("spent_7d"), ((F.col("spent_5h") <= 200) & (F.col("spent_7d") <= 600)).alias("allowed"))


@query("""
WITH r AS (SELECT user_id, event_id, ts, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW), 6) AS spent FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY spent DESC, ts, event_id) AS rn FROM r)
SELECT user_id, event_id, spent FROM b WHERE rn = 1""")
def busiest_window(spark: SparkSession, d: str) -> DataFrame:
    """End of each user's dearest 24 hours, the earliest of equals."""
    e = incremental.rolling_sums(table(spark, d, "events"), ["user_id"], "ts", "value", {"spent": 24}).withColumn("spent", F.round("spent", 6))
    return ranking.first_rows(e, ["user_id"], [F.col("spent").desc(), F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "spent")


@query("""SELECT strftime(ts - INTERVAL 12 HOUR, '%Y-%m-%d') AS night, count(*) AS n, round(sum(value), 4) AS spent FROM events GROUP BY 1""")
def nightly_spend(spark: SparkSession, d: str) -> DataFrame:
    """Spending of each night, from noon to noon."""
    night = F.date_format(F.col("ts") - F.expr("INTERVAL 12 HOURS"), "yyyy-MM-dd")
    return table(spark, d, "events").groupBy(night.alias("night")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("spent"))


@query("""
SELECT event_type AS stage, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, count(json_extract_string(props, '$.k')) AS with_k, round(sum(value) + 0.1 * count(*), 4) AS cost FROM events GROUP BY 1, 2""")
def usage_by_stage(spark: SparkSession, d: str) -> DataFrame:
    """Calls and weighted cost by stage and day."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"), F.count(F.get_json_object("props", "$.k")).alias("with_k"), F.round(F.sum("value") + 0.1 * F.count("*"), 4).alias("cost"))


@query("""SELECT d.doc_id, d.source, d.n_chars // 4 AS tokens FROM documents d ANTI JOIN labels l USING (doc_id) WHERE d.n_chars > 0""")
def resume_todo(spark: SparkSession, d: str) -> DataFrame:
    """What is left to do: the plan without what is saved."""
    plan = table(spark, d, "documents").where("n_chars > 0").select("doc_id", "source", F.floor(F.col("n_chars") / 4).alias("tokens"))
    return incremental.todo(plan, table(spark, d, "labels"), ["doc_id"])


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS attempts, count(*) >= 3 AS exhausted FROM events WHERE event_type = 'error' GROUP BY 1, 2""")
def attempts_exhausted(spark: SparkSession, d: str) -> DataFrame:
    """Failed attempts by user and day; three exhaust them."""
    return incremental.attempts(table(spark, d, "events").where("event_type = 'error'").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["user_id", "day"], 3)


@query("""
WITH s AS (SELECT l_orderkey AS win, l_linenumber AS idx, 'q' || (l_partkey % 50)::VARCHAR AS statement, CASE WHEN l_linenumber % 2 = 1 THEN round(l_discount * 10, 4) END AS score, round(l_tax * 10, 4) AS prior FROM lineitem),
v AS (SELECT l_orderkey AS win, l_linenumber AS idx, CASE WHEN l_orderkey % 7 = 0 THEN 'changed' ELSE ' q' || (l_partkey % 50)::VARCHAR || ' ' END AS statement, CASE l_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'mixed' ELSE 'unclear' END AS verdict FROM lineitem WHERE l_orderkey % 3 = 0),
j AS (SELECT s.*, v.verdict, v.statement AS vs FROM s LEFT JOIN v ON s.win = v.win AND s.idx = v.idx)
SELECT win, idx, CASE WHEN vs IS NOT NULL AND trim(vs) <> trim(statement) THEN 'stale' WHEN score IS NOT NULL THEN 'scored' WHEN verdict IN ('true', 'false', 'mixed') THEN 'resolved' WHEN verdict IS NOT NULL THEN 'pending' ELSE 'prior' END AS state,
 CASE WHEN score IS NOT NULL THEN score WHEN vs IS NOT NULL AND trim(vs) = trim(statement) THEN CASE verdict WHEN 'true' THEN 1.0 WHEN 'mixed' THEN 0.5 WHEN 'false' THEN 0.0 END END AS score, CASE WHEN score IS NULL THEN prior END AS prior_score FROM j""")
def verdict_join(spark: SparkSession, d: str) -> DataFrame:
    """Statements with their verdicts: joined by key, and only where the statement agrees; a
    guess stays apart from a checked score."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("win"), F.col("l_linenumber").alias("idx"), F.concat(F.lit("q"), (F.col("l_partkey") % 50).cast("string")).alias("q"), "l_discount", "l_tax")
    s = lines.select("win", "idx", F.col("q").alias("statement"), F.when(F.col("idx") % 2 == 1, F.round(F.col("l_discount") * 10, 4)).alias("score"), F.round(F.col("l_tax") * 10, 4).alias("prior"))
    k = F.col("win") % 4
    v = lines.where("win % 3 = 0").select("win", "idx", F.when(F.col("win") % 7 == 0, "changed").otherwise(F.concat(F.lit(" "), "q", F.lit(" "))).alias("statement"), F.when(k == 0, "true").when(k == 1, "false").when(k == 2, "mixed").otherwise("unclear").alias("verdict"))
    return incremental.join_verdicts(s, v, ["win", "idx"], {"true": 1.0, "mixed": 0.5, "false": 0.0})


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts (an extension of the reference)."""
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "total")


@query("""
WITH w AS (SELECT *, unnest([0, 1]) AS k FROM events) SELECT (time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR)::VARCHAR AS start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1""")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    """Two-hour windows that slide by one hour (an extension)."""
    e = table(spark, d, "events").groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total")


@query("""
WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM l)
SELECT user_id, min(ts)::VARCHAR AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid""")
def session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user, closed by six hours of silence (an extension)."""
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min("ts").alias("first"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    text = F.date_format("first", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return e.select("user_id", F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "").alias("start"), "n", "total")
