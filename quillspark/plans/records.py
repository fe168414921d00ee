"""Queries of records, votes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators import incremental, ranking, stats
from quillspark.plans.registry import query, table


@query("""
WITH a AS (SELECT l_returnflag AS arm, l_orderkey AS win, count(*) AS examples, sum(l_quantity) AS tokens FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2)
SELECT arm, count(*) AS windows, CAST(sum(examples) AS BIGINT) AS examples, round(sum(examples) / count(*)::DOUBLE, 6) AS per_window, round(1000.0 * sum(examples) / sum(tokens), 6) AS per_1000_tokens, round(sum(tokens) * 0.003 + sum(examples) * 0.015, 4) AS cost FROM a GROUP BY 1""")
def extraction_rates(spark: SparkSession, d: str) -> DataFrame:
    """Examples by window and by thousand tokens, and weighted cost, of two arms."""
    a = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy(F.col("l_returnflag").alias("arm"), "l_orderkey").agg(F.count("*").alias("e"), F.sum("l_quantity").alias("t"))
    e, t = F.sum("e"), F.sum("t")
    return a.groupBy("arm").agg(F.count("*").alias("windows"), e.alias("examples"), F.round(e / F.count("*"), 6).alias("per_window"), F.round(1000.0 * e / t, 6).alias("per_1000_tokens"), F.round(t * 0.003 + e * 0.015, 4).alias("cost"))


@query("""
WITH k AS (SELECT DISTINCT l_suppkey % 10 AS model, l_partkey AS statement FROM lineitem), r AS (SELECT statement FROM k WHERE model = 0),
n AS (SELECT model, count(*) AS n, count(r.statement) AS n_both FROM k LEFT JOIN r USING (statement) GROUP BY 1)
SELECT model, n, n_both, round(n_both / (n + (SELECT count(*) FROM r) - n_both)::DOUBLE, 10) AS jaccard, round(n_both / (SELECT count(*) FROM r)::DOUBLE, 10) AS recall FROM n WHERE model <> 0""")
def model_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each model's statements with the reference model's."""
    k = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("model"), F.col("l_partkey").alias("statement")).distinct()
    r = k.where("model = 0").select("statement", F.lit(1).alias("hit"))
    n = k.where("model <> 0").join(r, "statement", "left").groupBy("model").agg(F.count("*").alias("n"), F.count("hit").alias("n_both"))
    total = r.agg(F.count("*").alias("n_ref"))
    rows = n.join(F.broadcast(total))  # a single row
    return rows.select("model", "n", "n_both", F.round(F.col("n_both") / (F.col("n") + F.col("n_ref") - F.col("n_both")), 10).alias("jaccard"), F.round(F.col("n_both") / F.col("n_ref"), 10).alias("recall"))


@query("""
WITH s AS (SELECT o_custkey AS who, CASE WHEN o_orderpriority LIKE '1%' THEN 3 WHEN o_orderpriority LIKE '2%' THEN 2 ELSE 1 END AS weight, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY weight DESC, day, o_orderkey) AS rn FROM s)
SELECT who, o_orderkey AS decisive, weight, day FROM r WHERE rn = 1""")
def decisive_stage(spark: SparkSession, d: str) -> DataFrame:
    """The weightiest stage of each proposition, the first of equals."""
    p = F.substring("o_orderpriority", 1, 1)
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("decisive"), F.when(p == "1", 3).when(p == "2", 2).otherwise(1).alias("weight"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return ranking.first_rows(s, ["who"], [F.col("weight").desc(), F.col("day"), F.col("decisive")])


@query("""
SELECT o_orderstatus AS status, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months, count(*) FILTER (isodow(o_orderdate) IN (2, 3, 4)) AS sitting, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') AS in_term, count(DISTINCT yearweek(o_orderdate)) AS weeks FROM orders GROUP BY 1""")
def date_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Days, months and ISO weeks covered, and how much falls into the term."""
    o = F.col("o_orderdate")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), o).cast("string"), F.weekofyear(o).cast("string"))
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("n"), F.date_format(F.min(o), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(o), "yyyy-MM-dd").alias("last_day"), F.count_distinct(F.date_format(o, "yyyy-MM")).alias("months"),
        F.count_if(F.weekday(o).isin(1, 2, 3)).alias("sitting"), F.count_if(o >= F.lit("1996-01-01").cast("timestamp_ntz")).alias("in_term"), F.count_distinct(week).alias("weeks"),
    )


@query("""
WITH f AS (SELECT user_id, CAST(ts AS DATE) AS d, list_sort(list_distinct(list(event_type))) AS flags, map_from_entries(list_sort(list((event_type, v)))) AS m FROM (SELECT user_id, ts, event_type, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type) AS v FROM events) GROUP BY 1, 2)
SELECT flag, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, unnest(flags) AS flag FROM f) GROUP BY 1""")
def flag_frequency(spark: SparkSession, d: str) -> DataFrame:
    """How often each flag is set on a user's day."""
    f = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("flags"))  # five types
    return f.select("user_id", F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""
WITH p AS (SELECT doc_id, source, lang FROM documents WHERE length(text) >= 200), m AS (SELECT d.doc_id, count(*) AS mentions FROM documents d JOIN benchmark b ON contains(lower(trim(regexp_replace(d.text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')), lower(array_to_string(string_split_regex(trim(b.text), '[ \\t\\n\\r\\f]+')[1:4], ' '))) GROUP BY 1)
SELECT source, count(*) AS articles, count(*) FILTER (mentions >= 1) AS relevant, CAST(floor(100 * count(*) FILTER (mentions >= 1) / count(*)) AS BIGINT) AS percent FROM p LEFT JOIN m USING (doc_id) GROUP BY 1""")
def relevance_report(spark: SparkSession, d: str) -> DataFrame:
    """Articles of each source that mention an entity, in whole percent."""
    from quillspark.plans.texts import entity_mentions

    mentions = entity_mentions(spark, d).groupBy("doc_id").agg(F.count("*").alias("mentions"))
    p = table(spark, d, "documents").where(F.length("text") >= 200).select("doc_id", "source").join(mentions, "doc_id", "left")
    hit = F.count_if(F.col("mentions") >= 1)
    return p.groupBy("source").agg(F.count("*").alias("articles"), hit.alias("relevant"), F.floor(100 * hit / F.count("*")).alias("percent"))


@query("""
WITH o AS (SELECT c_custkey AS k, c_mktsegment AS v, 'old' AS origin FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, upper(c_mktsegment) AS v, 'new' AS origin FROM customer WHERE c_custkey % 5 = 0)
SELECT * FROM o ANTI JOIN n USING (k) UNION ALL SELECT * FROM n""")
def merged_entities(spark: SparkSession, d: str) -> DataFrame:
    """New records replace old ones of their key wholesale."""
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), F.lit("old").alias("origin"))
    new = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("k"), F.upper("c_mktsegment").alias("v"), F.lit("new").alias("origin"))
    return incremental.upsert(old, new, ["k"])


@query("""
WITH t AS (SELECT conv_id, turn, role, text, CASE WHEN regexp_matches(lower(text), 'read a third time') THEN 'third_reading' WHEN regexp_matches(text, '\\?') THEN 'question' WHEN length(text) < 80 THEN 'short' ELSE 'other' END AS kind FROM conversations)
SELECT role, kind, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, count(*) FILTER (length(text) < 80) AS under_80 FROM t GROUP BY 1, 2""")
def turn_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Turns by the first kind that fits."""
    text = F.col("text")
    kind = F.when(F.lower(text).rlike("read a third time"), "third_reading").when(text.rlike(r"\?"), "question").when(F.length(text) < 80, "short").otherwise("other")
    return table(spark, d, "conversations").groupBy("role", kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.count_if(F.length("text") < 80).alias("under_80"))


@query("""
WITH s AS (SELECT l_suppkey AS id, l_returnflag AS attr, l_discount * 10 AS v, l_orderkey, l_linenumber FROM lineitem), t AS (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY v DESC, id, l_orderkey, l_linenumber) AS top, row_number() OVER (PARTITION BY attr ORDER BY v, id, l_orderkey, l_linenumber) AS low FROM s)
SELECT attr, CASE WHEN top <= 5 THEN 'top' ELSE 'bottom' END AS part, id, l_orderkey, l_linenumber, round(v, 6) AS v FROM t WHERE top <= 5 OR low <= 5""")
def extreme_examples(spark: SparkSession, d: str) -> DataFrame:
    """Five highest and five lowest examples of each attribute (a top-k report).

    Each task keeps its own best first, so no attribute's rows are sorted in one task.
    """
    s = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("attr"), F.col("l_suppkey").alias("id"), "l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("v"))
    parts = []
    for name, sign in (("top", -1), ("bottom", 1)):
        local = s.withColumn("__p", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(64)))
        order = [sign * F.col("v"), F.col("id"), F.col("l_orderkey"), F.col("l_linenumber")]
        best = ranking.first_rows(ranking.first_rows(local, ["attr", "__p"], order, 5), ["attr"], order, 5)
        parts.append(best.select("attr", F.lit(name).alias("part"), "id", "l_orderkey", "l_linenumber", F.round("v", 6).alias("v")))
    return parts[0].unionByName(parts[1])


@query("""
WITH v AS (SELECT s_suppkey AS id, s_nationkey AS grp, s_acctbal AS v FROM supplier), g AS (SELECT grp, count(*) AS n, avg(v) AS m FROM v GROUP BY 1)
SELECT CASE WHEN grp < 12 THEN 'government' ELSE 'opposition' END AS bloc, CAST(sum(n) AS BIGINT) AS n, round(sum(n * m) / sum(n), 6) AS mean, round(max(m) - min(m), 6) AS widest_gap FROM g GROUP BY 1""")
def bloc_gap(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each bloc and the widest gap between its groups."""
    g = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.avg("s_acctbal").alias("m"))
    bloc = F.when(F.col("s_nationkey") < 12, "government").otherwise("opposition")
    return g.groupBy(bloc.alias("bloc")).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 6).alias("mean"), F.round(F.max("m") - F.min("m"), 6).alias("widest_gap"))


@query("""
WITH p AS (SELECT l_suppkey AS id, l_shipdate, l_discount * 10 AS guess, CASE WHEN l_linenumber % 2 = 0 THEN round(l_tax * 10, 4) END AS checked, l_returnflag AS attr FROM lineitem)
SELECT attr, count(*) AS n, count(checked) AS n_paired, round(CASE WHEN count(checked) >= 8 THEN covar_pop(CASE WHEN checked IS NOT NULL THEN guess END, checked) / sqrt(var_pop(CASE WHEN checked IS NOT NULL THEN guess END) * var_pop(checked)) END, 10) AS r, round(avg(abs(guess - checked)), 10) AS mean_gap, count(*) FILTER (abs(guess - checked) <= 0.25) AS agree, count(*) FILTER (abs(guess - checked) >= 0.5) AS flips FROM p GROUP BY 1""")
def guess_vs_checked(spark: SparkSession, d: str) -> DataFrame:
    """How guesses compare with checked scores, where both are there."""
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("attr"), (F.col("l_discount") * 10).alias("guess"), F.when(F.col("l_linenumber") % 2 == 0, F.round(F.col("l_tax") * 10, 4)).alias("checked"))
    gap = F.abs(F.col("guess") - F.col("checked"))
    return p.groupBy("attr").agg(F.count("*").alias("n"), F.count("checked").alias("n_paired"), F.round(stats.pearson(F.col("guess"), F.col("checked"), 8), 10).alias("r"), F.round(F.avg(gap), 10).alias("mean_gap"), F.count_if(gap <= 0.25).alias("agree"), F.count_if(gap >= 0.5).alias("flips"))


@query("""
WITH w AS (SELECT user_id, event_id, ts, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS upto FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM w WHERE upto >= 500)
SELECT user_id, event_id, round(upto, 4) AS upto FROM f WHERE rn = 1""")
def threshold_reached(spark: SparkSession, d: str) -> DataFrame:
    """The event at which each user's running sum first reaches the threshold."""
    order = [F.col("ts"), F.col("event_id")]
    w = table(spark, d, "events").withColumn("upto", F.sum("value").over(Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return ranking.first_rows(w.where("upto >= 500"), ["user_id"], order).select("user_id", "event_id", F.round("upto", 4).alias("upto"))


@query("""
SELECT p_brand AS brand, count(DISTINCT lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g'))) AS slugs, count(*) AS parts, min(substr(sha256(p_name), 1, 16)) AS first_id FROM part GROUP BY 1""")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct slugs and content ids of names."""
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count_distinct(T.slug(F.col("p_name"))).alias("slugs"), F.count("*").alias("parts"), F.min(T.score_key(F.col("p_name"))).alias("first_id"))
