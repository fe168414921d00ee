"""Queries of the statistics core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators import ranking, stats
from quillspark.plans.registry import query, table

_SHRUNK = """
WITH s AS ({source}), g AS (
  SELECT attribute, entity, count(*) n, avg(score) raw, coalesce(var_samp(score), 0) own FROM s WHERE score IS NOT NULL GROUP BY 1, 2),
e AS (SELECT attribute, avg(score) prior_mean, coalesce(var_samp(score), 0) total_var FROM s WHERE score IS NOT NULL GROUP BY 1),
p AS (SELECT attribute, avg(CASE WHEN n >= 2 THEN own END) pooled, coalesce(var_samp(raw), 0) observed, avg(1.0 / n) inverse FROM g GROUP BY 1),
q AS (SELECT p.attribute, prior_mean, greatest(1e-6, observed - coalesce(nullif(pooled, 0), total_var) * inverse) AS btw, greatest(1e-6, coalesce(nullif(pooled, 0), total_var)) AS wth FROM p JOIN e USING (attribute)),
r AS (SELECT g.*, prior_mean, btw, CASE WHEN n < 2 THEN wth ELSE greatest(1e-6, (n - 1.0) / (n + 3.0) * own + (1 - (n - 1.0) / (n + 3.0)) * wth) END / n AS se2 FROM g JOIN q USING (attribute)),
t AS (SELECT *, btw / (btw + se2) AS shr, 1.96 * sqrt(1 / (1 / btw + 1 / se2)) AS ci FROM r),
u AS (SELECT *, shr * raw + (1 - shr) * prior_mean AS adj FROM t)
SELECT entity, attribute, n, round(raw, 10) AS raw, round(adj, 10) AS adjusted, round(shr, 10) AS shrink, round(ci, 10) AS ci95,
  CASE WHEN shr < 0.25 THEN 'low' WHEN ci <= 0.05 AND n >= 8 AND shr >= 0.5 THEN 'high' WHEN ci <= 0.12 AND n >= 3 THEN 'medium' ELSE 'low' END AS confidence,
  CAST(round_even(100 * adj, 0) AS INTEGER) AS display FROM u
"""


def _shrunk(df: DataFrame) -> DataFrame:
    out = stats.shrink(df, "entity", "attribute", "score")
    return out.select("entity", "attribute", "n", *(F.round(c, 10).alias(c) for c in ("raw", "adjusted", "shrink", "ci95")), "confidence", "display")


@query(_SHRUNK.format(source="SELECT user_id AS entity, event_type AS attribute, 0.7 * least(1.0, value / 100) + 0.3 * (user_id % 7) / 6.0 AS score FROM events"))
def shrunk_scores(spark: SparkSession, d: str) -> DataFrame:
    """Shrunk score of each user and event type."""
    score = 0.7 * F.least(F.lit(1.0), F.col("value") / 100) + 0.3 * (F.col("user_id") % 7) / 6.0
    return _shrunk(table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("attribute"), score.alias("score")))


@query(_SHRUNK.format(source="SELECT l_suppkey AS entity, l_returnflag AS attribute, l_discount * 10 AS score FROM lineitem"))
def shrunk_scores_raw(spark: SparkSession, d: str) -> DataFrame:
    """Shrinkage where entities hardly differ: the between-variance is near its floor."""
    return _shrunk(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("attribute"), (F.col("l_discount") * 10).alias("score")))


@query(_SHRUNK.format(source="SELECT l_suppkey AS entity, l_returnflag AS attribute, (l_discount * 10 + (l_suppkey % 10) / 9.0) / 2 AS score FROM lineitem"))
def shrunk_scores_high(spark: SparkSession, d: str) -> DataFrame:
    """Shrinkage with many observations and a real effect."""
    score = (F.col("l_discount") * 10 + (F.col("l_suppkey") % 10) / 9.0) / 2
    return _shrunk(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("attribute"), score.alias("score")))


@query("""
SELECT c_custkey AS entity, CAST(count(o_orderkey) AS BIGINT) AS total, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS done,
  CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS stopped, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS open,
  round(count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus IN ('F', 'P')), 0)::DOUBLE, 6) AS delivery_rate,
  count(o_orderkey) = 0 AS insufficient FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def entity_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Record of each customer: orders are pre-aggregated, then joined; no rate where nothing is resolved."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("total"), *(F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("F", "done"), ("P", "stopped"), ("O", "open"))))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("entity")).join(orders, "entity", "left")
    rows = rows.fillna(0, ["total", "done", "stopped", "open"])
    return rows.select("entity", "total", "done", "stopped", "open", F.round(stats.ratio(F.col("done"), F.nullif(F.col("done") + F.col("stopped"), F.lit(0))), 6).alias("delivery_rate"), (F.col("total") == 0).alias("insufficient"))


@query("""
WITH a AS (SELECT l_suppkey AS entity, sum(l_extendedprice) rev, count(*) n, avg(l_discount) disc FROM lineitem GROUP BY 1),
b AS (SELECT s_suppkey AS entity, s_nationkey AS cohort, CASE WHEN s_suppkey % 11 <> 0 THEN round(rev, 2) END AS rev, n, round(disc, 6) AS disc FROM supplier LEFT JOIN a ON s_suppkey = entity),
p AS (SELECT entity, cohort,
  CASE WHEN rev IS NULL THEN NULL WHEN count(rev) OVER w = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY cohort ORDER BY rev NULLS LAST) - 1 + (count(rev) OVER (PARTITION BY cohort, rev) - 1) / 2.0) / (count(rev) OVER w - 1) END AS rev_rank,
  CASE WHEN n IS NULL THEN NULL WHEN count(n) OVER w = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY cohort ORDER BY n NULLS LAST) - 1 + (count(n) OVER (PARTITION BY cohort, n) - 1) / 2.0) / (count(n) OVER w - 1) END AS n_rank,
  CASE WHEN disc IS NULL THEN NULL WHEN count(disc) OVER w = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY cohort ORDER BY disc NULLS LAST) - 1 + (count(disc) OVER (PARTITION BY cohort, disc) - 1) / 2.0) / (count(disc) OVER w - 1) END AS disc_rank
  FROM b WINDOW w AS (PARTITION BY cohort))
SELECT entity, cohort, round(rev_rank, 6) AS rev_rank, round(n_rank, 6) AS n_rank, round(disc_rank, 6) AS disc_rank,
  round((coalesce(0.5 * rev_rank, 0) + coalesce(0.3 * n_rank, 0) + coalesce(0.2 * disc_rank, 0)) / nullif(CASE WHEN rev_rank IS NULL THEN 0 ELSE 0.5 END + CASE WHEN n_rank IS NULL THEN 0 ELSE 0.3 END + CASE WHEN disc_rank IS NULL THEN 0 ELSE 0.2 END, 0), 6) AS blend FROM p""")
def cohort_percentile_blend(spark: SparkSession, d: str) -> DataFrame:
    """Places of suppliers among those of their nation, and their weighted blend."""
    a = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(F.sum("l_extendedprice").alias("rev"), F.count("*").alias("n"), F.avg("l_discount").alias("disc"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("cohort")).join(a, "entity", "left")
    b = b.select("entity", "cohort", F.when(F.col("entity") % 11 != 0, F.round("rev", 2)).alias("rev"), "n", F.round("disc", 6).alias("disc"))
    p = b.withColumns({f"{c}_rank": ranking.percentile_rank(F.col(c), ["cohort"]) for c in ("rev", "n", "disc")})
    blend = ranking.blend([(F.col("rev_rank"), 0.5), (F.col("n_rank"), 0.3), (F.col("disc_rank"), 0.2)])
    return p.select("entity", "cohort", *(F.round(f"{c}_rank", 6).alias(f"{c}_rank") for c in ("rev", "n", "disc")), F.round(blend, 6).alias("blend"))


@query("""
WITH v AS (SELECT c_mktsegment AS proposition, n_name AS who, o_orderstatus AS side, CASE WHEN o_orderpriority LIKE '1%' THEN 3 WHEN o_orderpriority LIKE '2%' THEN 2 WHEN o_orderpriority LIKE '5%' THEN 0 ELSE 1 END AS weight
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus IN ('F', 'O')),
t AS (SELECT proposition, who, CAST(sum(CASE WHEN side = 'F' THEN weight ELSE 0 END) AS BIGINT) AS support_weight, CAST(sum(CASE WHEN side = 'O' THEN weight ELSE 0 END) AS BIGINT) AS oppose_weight, count(*) AS n_votes FROM v GROUP BY 1, 2)
SELECT *, CASE WHEN support_weight + oppose_weight = 0 THEN NULL WHEN support_weight = oppose_weight THEN 'mixed' WHEN support_weight > oppose_weight THEN 'support' ELSE 'oppose' END AS stance FROM t""")
def stance_vote(spark: SparkSession, d: str) -> DataFrame:
    """Stance of each nation on each segment by weighted votes; a tie is mixed, weightless votes count as votes only."""
    customers = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name")
    p = F.substring("o_orderpriority", 1, 1)
    weight = F.when(p == "1", 3).when(p == "2", 2).when(p == "5", 0).otherwise(1)
    votes = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O")).select("o_custkey", "o_orderstatus", weight.alias("weight")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    side = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("weight")).otherwise(0)).cast("bigint")
    t = votes.groupBy(F.col("c_mktsegment").alias("proposition"), F.col("n_name").alias("who")).agg(side("F").alias("support_weight"), side("O").alias("oppose_weight"), F.count("*").alias("n_votes"))
    s, o = F.col("support_weight"), F.col("oppose_weight")
    return t.withColumn("stance", F.when(s + o == 0, None).when(s == o, "mixed").when(s > o, "support").otherwise("oppose"))


@query("""
WITH l AS (SELECT l_suppkey, l_returnflag, l_linestatus, l_tax, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
mem AS (SELECT l_suppkey, l_returnflag, CASE WHEN f > o THEN 'F' WHEN o > f THEN 'O' END AS rec FROM (SELECT l_suppkey, l_returnflag, count(*) FILTER (l_linestatus = 'F') f, count(*) FILTER (l_linestatus = 'O') o FROM l WHERE l_suppkey % 3 = 0 GROUP BY 1, 2)),
grp AS (SELECT s_nationkey, l_returnflag, CASE WHEN f > o THEN 'F' WHEN o > f THEN 'O' END AS rec FROM (SELECT s_nationkey, l_returnflag, count(*) FILTER (l_linestatus = 'F') f, count(*) FILTER (l_linestatus = 'O') o FROM l GROUP BY 1, 2)),
j AS (SELECT l.l_suppkey AS entity, coalesce(mem.rec, grp.rec) AS rec, CASE WHEN mem.rec IS NOT NULL THEN 'member' WHEN grp.rec IS NOT NULL THEN 'party' END AS basis, l_linestatus FROM l LEFT JOIN mem USING (l_suppkey, l_returnflag) LEFT JOIN grp USING (s_nationkey, l_returnflag) WHERE l_tax < 0.04)
SELECT entity, count(*) AS n_positions, count(rec) AS n_scored, count(*) FILTER (rec = l_linestatus) AS n_consistent, round_even(count(*) FILTER (rec = l_linestatus) / nullif(count(rec), 0)::DOUBLE, 4) AS rate,
  CASE WHEN count(rec) = 0 THEN NULL WHEN count(*) FILTER (basis = 'party') = 0 THEN 'member' WHEN count(*) FILTER (basis = 'member') = 0 THEN 'party' ELSE 'mixed' END AS basis FROM j GROUP BY 1""")
def consistency_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of positions that agree with the record: the member's own, else the group's; a
    tied record scores nothing, and what can't be scored is in neither side of the rate."""
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_tax").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey")

    def record(df: DataFrame, key: str, name: str) -> DataFrame:
        f, o = F.count_if(F.col("l_linestatus") == "F"), F.count_if(F.col("l_linestatus") == "O")
        return df.groupBy(key, "l_returnflag").agg(F.when(f > o, "F").when(o > f, "O").alias(name))

    rows = lines.where("l_tax < 0.04").join(record(lines.where("l_suppkey % 3 = 0"), "l_suppkey", "own"), ["l_suppkey", "l_returnflag"], "left").join(record(lines, "s_nationkey", "group_"), ["s_nationkey", "l_returnflag"], "left")
    rows = rows.withColumns({"rec": F.coalesce("own", "group_"), "basis": F.when(F.col("own").isNotNull(), "member").when(F.col("group_").isNotNull(), "party")})
    hit, scored = F.count_if(F.col("rec") == F.col("l_linestatus")), F.count("rec")
    basis = F.when(scored == 0, None).when(F.count_if(F.col("basis") == "party") == 0, "member").when(F.count_if(F.col("basis") == "member") == 0, "party").otherwise("mixed")
    return rows.groupBy(F.col("l_suppkey").alias("entity")).agg(F.count("*").alias("n_positions"), scored.alias("n_scored"), hit.alias("n_consistent"), F.bround(stats.ratio(hit, F.nullif(scored, F.lit(0))), 4).alias("rate"), basis.alias("basis"))


@query("""
WITH k AS (SELECT l_returnflag AS attr, l_partkey AS key, avg(l_discount) AS score FROM lineitem GROUP BY 1, 2), n AS (SELECT attr, count(*) n FROM k GROUP BY 1),
j AS (SELECT a.attr AS a, b.attr AS b, count(*) n_both, covar_pop(a.score, b.score) c, var_pop(a.score) va, var_pop(b.score) vb, avg(abs(a.score - b.score)) gap FROM k a JOIN k b ON a.key = b.key AND a.attr < b.attr GROUP BY 1, 2)
SELECT a, b, n_both, round(CASE WHEN n_both >= 30 AND va > 0 AND vb > 0 THEN c / sqrt(va * vb) END, 10) AS r, round(n_both / (na.n + nb.n - n_both)::DOUBLE, 10) AS jaccard, round(n_both / na.n::DOUBLE, 10) AS share_a, round(n_both / nb.n::DOUBLE, 10) AS share_b, round(gap, 10) AS mean_gap
FROM j JOIN n na ON na.attr = a JOIN n nb ON nb.attr = b""")
def attribute_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How far two attributes score the same statements, and agree where they do."""
    k = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("attr"), F.col("l_partkey").alias("key")).agg(F.avg("l_discount").alias("score"))
    n = k.groupBy("attr").agg(F.count("*").alias("n"))
    a, b = k.select(F.col("attr").alias("a"), "key", F.col("score").alias("x")), k.select(F.col("attr").alias("b"), "key", F.col("score").alias("y"))
    j = a.join(b, "key").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_both"), stats.pearson(F.col("x"), F.col("y"), 30).alias("r"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("gap"))
    j = j.join(n.select(F.col("attr").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("attr").alias("b"), F.col("n").alias("nb")), "b")
    share = lambda whole: F.round(stats.ratio(F.col("n_both"), whole), 10)
    return j.select("a", "b", "n_both", F.round("r", 10).alias("r"), share(F.col("na") + F.col("nb") - F.col("n_both")).alias("jaccard"), share(F.col("na")).alias("share_a"), share(F.col("nb")).alias("share_b"), F.round("gap", 10).alias("mean_gap"))


@query("""
WITH p AS (SELECT lang, quality::DOUBLE AS gold, least(1.0, n_chars / 4000.0) AS pred FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) AS n, round(avg(abs(pred - gold)), 10) AS mae, round(sqrt(avg((pred - gold) * (pred - gold))), 10) AS rmse, round(avg(CASE WHEN (pred >= 0.5) = (gold >= 0.5) THEN 1.0 ELSE 0.0 END), 10) AS binary_accuracy,
  round(CASE WHEN count(*) >= 2 AND var_pop(gold) > 0 AND var_pop(pred) > 0 THEN covar_pop(gold, pred) / sqrt(var_pop(gold) * var_pop(pred)) END, 10) AS r FROM p GROUP BY 1""")
def error_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Errors of a heuristic prediction of the quality label, by language."""
    pairs = table(spark, d, "documents").select("doc_id", "lang", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("pred")).join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("gold")), "doc_id")
    out = pairs.groupBy("lang").agg(*stats.error_metrics(F.col("gold"), F.col("pred")))
    return out.select("lang", "n", *(F.round(c, 10).alias(c) for c in ("mae", "rmse", "binary_accuracy", "r")))


@query("""
WITH v AS (SELECT l_suppkey AS entity, l_returnflag AS attr, sum(l_quantity) / 100 AS v FROM lineitem GROUP BY 1, 2),
g AS (SELECT entity, count(*) AS n_attrs, round(exp(avg(ln(greatest(v, 1.0)))), 6) AS overall FROM v GROUP BY 1 HAVING count(*) >= 3)
SELECT entity, n_attrs, overall, row_number() OVER (ORDER BY overall DESC, entity) AS rank FROM g""")
def geo_mean_rank(spark: SparkSession, d: str) -> DataFrame:
    """Overall rank by geometric mean, of entities with enough attributes."""
    v = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), "l_returnflag").agg((F.sum("l_quantity") / 100).alias("v"))
    g = v.groupBy("entity").agg(F.count("*").alias("n_attrs"), F.round(stats.geometric_mean(F.col("v")), 6).alias("overall")).where("n_attrs >= 3")
    return ranking.global_row_number(g, [F.col("overall").desc(), F.col("entity").asc()])


@query("""
WITH g AS (SELECT n_name AS grp, count(*) AS n, avg(s_acctbal) AS mean, count(*) FILTER (s_acctbal < 0) * 2 > count(*) AS mostly_negative FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
h AS (SELECT sum(n * mean) / sum(n) AS house FROM g), w AS (SELECT max(abs(mean - house)) AS widest FROM g, h WHERE n >= 3)
SELECT grp, n, n < 3 AS too_small, mostly_negative, round(CASE WHEN n >= 3 THEN mean END, 6) AS mean, round(CASE WHEN n >= 3 THEN (mean - house) / nullif(widest, 0) END, 6) AS deviation FROM g, h, w""")
def group_deviation(spark: SparkSession, d: str) -> DataFrame:
    """Groups' deviation from the house mean, scaled to the widest; groups below three are
    reported without a mean."""
    g = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("grp")).agg(F.count("*").alias("n"), F.avg("s_acctbal").alias("mean"), (F.count_if(F.col("s_acctbal") < 0) * 2 > F.count("*")).alias("mostly_negative"))
    house = g.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("house"))
    large = F.when(F.col("n") >= 3, F.col("mean"))
    rows = g.join(F.broadcast(house))  # single rows, both
    rows = rows.join(F.broadcast(rows.agg(F.max(F.abs(large - F.col("house"))).alias("widest"))))
    return rows.select("grp", "n", (F.col("n") < 3).alias("too_small"), "mostly_negative", F.round(large, 6).alias("mean"), F.round((large - F.col("house")) / F.nullif(F.col("widest"), F.lit(0.0)), 6).alias("deviation"))


@query("""SELECT l_returnflag AS attr, CAST(least(19, greatest(0, floor(l_discount * 10 * 20))) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of 20 bins, the last one closed."""
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("attr"), stats.histogram_bin(F.col("l_discount") * 10, 20).alias("bin")).agg(F.count("*").alias("n"))


@query("""
WITH v AS (SELECT n_regionkey AS grp, (s_acctbal + 1000) / 110 AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey), p AS (SELECT unnest(range(0, 81)) AS point)
SELECT grp, CAST(point AS INTEGER) AS point, round(point * 1.25, 6) AS x, count(*) AS n, round(sum(exp(-0.5 * ((point * 1.25 - v) / 6) * ((point * 1.25 - v) / 6))) / (count(*) * 6 * sqrt(2 * pi())), 9) AS density FROM v, p GROUP BY 1, 2, 3""")
def kde_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Kernel density of balances by region on an 81-point grid."""
    v = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("grp"), ((F.col("s_acctbal") + 1000) / 110).alias("v"))
    return stats.density(v, "grp", "v").select("grp", "point", F.round("x", 6).alias("x"), "n", F.round("density", 9).alias("density"))


@query("""
WITH g AS (SELECT l_returnflag AS attr, l_suppkey, count(*) n, avg(l_discount) m, var_samp(l_discount) v FROM lineitem GROUP BY 1, 2)
SELECT attr, count(*) AS n_entities, CAST(sum(n) AS BIGINT) AS n, round(var_samp(m), 9) AS observed_var, round(avg(v / n), 9) AS sampling_var, round(greatest(0, var_samp(m) - avg(v / n)), 9) AS between_var, round(sqrt(greatest(0, var_samp(m) - avg(v / n))) / nullif(sqrt(avg(v)), 0), 6) AS spread, round(max(m) - min(m), 6) AS bench_gap FROM g WHERE n >= 2 GROUP BY 1""")
def between_within_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether entities differ beyond sampling: variance of their means against the mean sampling variance."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("attr"), "l_suppkey").agg(F.count("*").alias("n"), F.avg("l_discount").alias("m"), F.var_samp("l_discount").alias("v")).where("n >= 2")
    observed, sampling = F.var_samp("m"), F.avg(F.col("v") / F.col("n"))
    between = F.greatest(F.lit(0.0), observed - sampling)
    return g.groupBy("attr").agg(F.count("*").alias("n_entities"), F.sum("n").alias("n"), F.round(observed, 9).alias("observed_var"), F.round(sampling, 9).alias("sampling_var"), F.round(between, 9).alias("between_var"), F.round(F.sqrt(between) / F.nullif(F.sqrt(F.avg("v")), F.lit(0.0)), 6).alias("spread"), F.round(F.max("m") - F.min("m"), 6).alias("bench_gap"))


@query("""
SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(floor(median(n_chars)) AS BIGINT) AS median_chars, min(n_chars) AS shortest, max(n_chars) AS longest, count(DISTINCT lang) AS langs, CAST(grouping(source) AS INTEGER) AS is_total FROM documents GROUP BY ROLLUP (source)""")
def corpus_stats_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Corpus report by source, with a grand-total row."""
    rows = table(spark, d, "documents").rollup("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.floor(F.median("n_chars")).cast("bigint").alias("median_chars"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.count_distinct("lang").alias("langs"), F.grouping("source").cast("int").alias("is_total"))
    return rows


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (o_orderpriority = '1-URGENT') AS p1, count(*) FILTER (o_orderpriority = '2-HIGH') AS p2, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS p3, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS other FROM orders GROUP BY 1""")
def source_month_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Counts by month with one column for each priority."""
    named = F.when(F.col("o_orderpriority") == "1-URGENT", "p1").when(F.col("o_orderpriority") == "2-HIGH", "p2").when(F.col("o_orderpriority") == "3-MEDIUM", "p3").otherwise("other")
    rows = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), named.alias("name"))
    return rows.groupBy("month").pivot("name", ["p1", "p2", "p3", "other"]).count().fillna(0)


@query("""SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1""")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    """Share of each event type in all events."""
    by_type = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = by_type.agg(F.sum("n").alias("total"))
    return by_type.join(F.broadcast(total)).select("event_type", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("share"))


@query("""
WITH c AS (SELECT c_custkey, count(o_orderkey) AS n, bool_or(coalesce(o_orderstatus = 'F', false)) AS a, bool_or(coalesce(o_orderpriority = '1-URGENT', false)) AS b FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT CASE WHEN n = 0 THEN '0' WHEN n < 10 THEN '1-9' WHEN n < 50 THEN '10-49' ELSE '50+' END AS bucket, count(*) AS entities, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (a) AS with_a, count(*) FILTER (a OR b) AS with_a_or_b FROM c GROUP BY 1""")
def coverage_buckets(spark: SparkSession, d: str) -> DataFrame:
    """How many customers have how much evidence, and what each kind of evidence adds."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("b"))
    c = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))
    bucket = F.when(F.col("n") == 0, "0").when(F.col("n") < 10, "1-9").when(F.col("n") < 50, "10-49").otherwise("50+")
    return c.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("entities"), F.sum("n").alias("n"), F.count_if("a").alias("with_a"), F.count_if(F.col("a") | F.col("b")).alias("with_a_or_b"))


@query("""
WITH t AS (SELECT l_suppkey AS entity, l_returnflag AS attr, avg(l_discount) * 10 AS s, count(*) AS n FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2),
r AS (SELECT l_suppkey AS entity, 'R' AS attr, avg(o_totalprice) / 500000 AS s, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 4 = 0 GROUP BY 1)
SELECT coalesce(r.entity, t.entity) AS entity, coalesce(r.attr, t.attr) AS attr, round(coalesce(r.s, t.s), 10) AS score, coalesce(r.n, t.n) AS n, CASE WHEN r.entity IS NOT NULL THEN 'record' ELSE 'text' END AS tier FROM t FULL JOIN r ON t.entity = r.entity AND t.attr = r.attr""")
def record_overrides_text(spark: SparkSession, d: str) -> DataFrame:
    """Scores from the record replace those from text; entities of either kind are kept."""
    lines = table(spark, d, "lineitem")
    t = lines.where("l_suppkey % 5 <> 0").groupBy(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("attr")).agg((F.avg("l_discount") * 10).alias("ts"), F.count("*").alias("tn"))
    r = lines.where("l_suppkey % 4 = 0").select("l_suppkey", "l_orderkey").join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    r = r.groupBy(F.col("l_suppkey").alias("entity"), F.lit("R").alias("attr")).agg((F.avg("o_totalprice") / 500000).alias("rs"), F.count("*").alias("rn"))
    return t.join(r, ["entity", "attr"], "full").select("entity", "attr", F.round(F.coalesce("rs", "ts"), 10).alias("score"), F.coalesce("rn", "tn").alias("n"), F.when(F.col("rn").isNotNull(), "record").otherwise("text").alias("tier"))


@query("""
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, round(o_totalprice, 2) AS v FROM orders WHERE o_orderkey % 17 <> 0), b AS (SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 23 = 0 THEN round(o_totalprice, 2) + 1 ELSE round(o_totalprice, 2) END AS v FROM orders WHERE o_orderkey % 19 <> 0)
SELECT coalesce(a.s, b.s) AS status, count(*) FILTER (b.k IS NULL) AS only_old, count(*) FILTER (a.k IS NULL) AS only_new, count(*) FILTER (a.v = b.v) AS same, count(*) FILTER (a.v <> b.v) AS changed FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Rows that only one of two versions has, and those that changed."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.round("o_totalprice", 2).alias("v"))
    a = o.where("k % 17 <> 0").select("k", F.col("s").alias("sa"), F.col("v").alias("va"))
    b = o.where("k % 19 <> 0").select("k", F.col("s").alias("sb"), F.when(F.col("k") % 23 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("vb"))
    both = a.join(b, "k", "full")
    return both.groupBy(F.coalesce("sa", "sb").alias("status")).agg(F.count_if(F.col("sb").isNull()).alias("only_old"), F.count_if(F.col("sa").isNull()).alias("only_new"), F.count_if(F.col("va") == F.col("vb")).alias("same"), F.count_if(F.col("va") != F.col("vb")).alias("changed"))


@query("""SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_entities(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no label covers."""
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts, event_id) - 1 AS repeat_no FROM events), q AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, repeat_no, least(1.0, value / 100) AS s FROM p)
SELECT a.event_type, count(*) AS n_pairs, round(avg(abs(a.s - b.s)), 10) AS mean_gap, count(*) FILTER (abs(a.s - b.s) <= 0.25) AS agree, count(*) FILTER ((a.s >= 0.5) <> (b.s >= 0.5)) AS flips FROM q a JOIN q b ON a.user_id = b.user_id AND a.d = b.d AND a.event_type = b.event_type AND a.repeat_no = 0 AND b.repeat_no = 1 GROUP BY 1""")
def self_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Gap between the first two scores of the same thing, and how many agree or flip."""
    keys = ["user_id", "day", "event_type"]
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "ts", "event_id", F.least(F.lit(1.0), F.col("value") / 100).alias("s"))
    e = e.withColumn("repeat_no", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id")) - 1)
    both = e.where("repeat_no < 2").groupBy(*keys).agg(F.max(F.when(F.col("repeat_no") == 0, F.col("s"))).alias("a"), F.max(F.when(F.col("repeat_no") == 1, F.col("s"))).alias("b")).where("b is not null")
    gap = F.abs(F.col("a") - F.col("b"))
    return both.groupBy("event_type").agg(F.count("*").alias("n_pairs"), F.round(F.avg(gap), 10).alias("mean_gap"), F.count_if(gap <= 0.25).alias("agree"), F.count_if((F.col("a") >= 0.5) != (F.col("b") >= 0.5)).alias("flips"))


@query("""
WITH t AS (SELECT l_returnflag AS g, list(l_quantity ORDER BY l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1)
SELECT g AS grp, n, v[n // 2 + 1] AS upper_median, (v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2 AS median FROM t""")
def medians(spark: SparkSession, d: str) -> DataFrame:
    """Upper-middle and interpolated median of quantities, from counts of each value."""
    counts = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("v")).agg(F.count("*").alias("k"))
    over = Window.partitionBy("grp").orderBy("v")
    c = counts.withColumns({"upto": F.sum("k").over(over), "n": F.sum("k").over(Window.partitionBy("grp"))})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    upper, lower = at(F.floor(F.col("n") / 2)), at(F.floor((F.col("n") - 1) / 2))
    return c.groupBy("grp", "n").agg(upper.alias("upper_median"), ((lower + upper) / 2).alias("median"))


@query("""
WITH c AS (SELECT p_partkey AS card, p_size % 10 + 1 AS strength, CAST(floor(p_retailprice) AS BIGINT) % 10 + 1 AS rigor, p_partkey % 10 + 1 AS veracity, p_size % 7 + 1 AS divination, p_partkey % 100 AS charisma, p_partkey % 90 AS forthrightness, p_size % 50 AS civility, p_brand AS deck FROM part),
s AS (SELECT *, 100 * strength AS hp, strength * rigor AS attack, strength * veracity AS defence, row_number() OVER (PARTITION BY deck ORDER BY divination DESC, card) AS turn, 2 + floor(sum(charisma) OVER (PARTITION BY deck) / 100) AS slots FROM c)
SELECT a.deck, CAST(a.slots AS BIGINT) AS slots, CAST(a.turn AS BIGINT) AS turn, a.card, b.card AS target, CAST(greatest(0, a.attack - b.defence) AS BIGINT) AS damage, CAST(a.attack * b.forthrightness // 100 AS BIGINT) AS reflected, CAST(a.civility // 10 AS BIGINT) AS pierced, CAST(greatest(0, b.hp - greatest(0, a.attack - b.defence)) AS BIGINT) AS target_hp,
  CASE WHEN b.hp - greatest(0, a.attack - b.defence) <= 0 AND a.hp - a.attack * b.forthrightness // 100 <= 0 THEN 'draw' WHEN b.hp - greatest(0, a.attack - b.defence) <= 0 THEN 'attacker' WHEN a.hp - a.attack * b.forthrightness // 100 <= 0 THEN 'defender' END AS fallen
FROM s a JOIN s b ON a.deck = b.deck AND b.turn = a.turn + 1""")
def card_round(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic part of a card round: stats, slots, order of attack, damage, reflection, pierce and outcome."""
    p = table(spark, d, "part")
    c = p.select(F.col("p_partkey").alias("card"), (F.col("p_size") % 10 + 1).cast("bigint").alias("strength"), (F.floor("p_retailprice") % 10 + 1).alias("rigor"), (F.col("p_partkey") % 10 + 1).alias("veracity"), (F.col("p_size") % 7 + 1).alias("divination"), (F.col("p_partkey") % 100).alias("charisma"), (F.col("p_partkey") % 90).alias("forthrightness"), (F.col("p_size") % 50).cast("bigint").alias("civility"), F.col("p_brand").alias("deck"))
    by = Window.partitionBy("deck")
    nxt = by.orderBy(F.col("divination").desc(), "card")
    s = c.withColumns({"hp": 100 * F.col("strength"), "attack": F.col("strength") * F.col("rigor"), "defence": F.col("strength") * F.col("veracity"), "turn": F.row_number().over(nxt).cast("bigint"), "slots": 2 + F.floor(F.sum("charisma").over(by) / 100)})
    s = s.withColumns({f"t_{x}": F.lead(x).over(nxt) for x in ("card", "defence", "hp", "forthrightness")}).where("t_card is not null")
    damage = F.greatest(F.lit(0), F.col("attack") - F.col("t_defence"))
    reflected = F.floor(F.col("attack") * F.col("t_forthrightness") / 100)
    down, hurt = F.col("t_hp") - damage <= 0, F.col("hp") - reflected <= 0
    return s.select("deck", "slots", "turn", "card", F.col("t_card").alias("target"), damage.alias("damage"), reflected.alias("reflected"), F.floor(F.col("civility") / 10).alias("pierced"), F.greatest(F.lit(0), F.col("t_hp") - damage).alias("target_hp"), F.when(down & hurt, "draw").when(down, "attacker").when(hurt, "defender").alias("fallen"))
