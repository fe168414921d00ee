"""Queries of released data: merged edits, bundles, documents of mixed shapes, windows by address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import mixed
from quillspark.operators import addresses, evaluation, merge, roster
from quillspark.operators.ranking import shared_path
from quillspark.plans.registry import query, table
from quillspark.sources import bundles

_EDITS = """
WITH base AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority, o_custkey AS owner FROM orders),
ours AS (SELECT k, CASE WHEN owner % 5 = 0 THEN 'P' ELSE status END AS status, CASE WHEN owner % 7 = 0 THEN 'none' ELSE priority END AS priority, owner FROM base WHERE k % 11 <> 0 UNION ALL SELECT -c_custkey, 'N', 'new', c_custkey FROM customer WHERE c_custkey % 50 = 1),
theirs AS (SELECT k, CASE WHEN owner % 3 = 0 THEN 'F' ELSE status END AS status, priority, CASE WHEN k % 13 = 0 THEN owner + 1 ELSE owner END AS owner FROM base WHERE k % 17 <> 0),
j AS (SELECT coalesce(b.k, o.k, t.k) AS k, b, o, t FROM base b FULL JOIN ours o ON b.k = o.k FULL JOIN theirs t ON coalesce(b.k, o.k) = t.k),
c AS (SELECT *, b.k IS NULL AS unknown, b.k IS NOT NULL AND ((o.k IS NULL AND t.k IS NOT NULL AND t <> b) OR (t.k IS NULL AND o.k IS NOT NULL AND o <> b)) AS dropped,
  b.k IS NOT NULL AND o.k IS NOT NULL AND t.k IS NOT NULL AND o.status <> b.status AND t.status <> b.status AND o.status <> t.status AS status_clash FROM j)
"""


def _edits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("owner"))
    new = table(spark, d, "customer").where("c_custkey % 50 = 1").select((-F.col("c_custkey")).alias("k"), F.lit("N").alias("status"), F.lit("new").alias("priority"), F.col("c_custkey").alias("owner"))
    when = lambda c, v, e: F.when(F.expr(c), F.lit(v) if isinstance(v, str) else v).otherwise(F.col(e)).alias(e)
    ours = base.where("k % 11 <> 0").select("k", when("owner % 5 = 0", "P", "status"), when("owner % 7 = 0", "none", "priority"), "owner").unionByName(new)
    theirs = base.where("k % 17 <> 0").select("k", when("owner % 3 = 0", "F", "status"), "priority", when("k % 13 = 0", F.col("owner") + 1, "owner"))
    return base, ours, theirs


@query(_EDITS + """
SELECT k, CASE WHEN status_clash OR dropped THEN b.status WHEN o.status = b.status THEN t.status ELSE o.status END AS status, CASE WHEN status_clash OR dropped THEN b.priority ELSE o.priority END AS priority, CASE WHEN status_clash OR dropped THEN b.owner ELSE t.owner END AS owner
FROM c WHERE NOT unknown AND (dropped OR (o.k IS NOT NULL AND t.k IS NOT NULL))""")
def merged_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with two sides' edits merged, rows in conflict as they were."""
    return merge.merge3(*_edits(spark, d), ["k"])[0]


@query(_EDITS + """
SELECT k, CASE WHEN unknown THEN 'unknown' WHEN dropped THEN 'deleted_and_changed' ELSE 'both_changed' END AS kind, CASE WHEN status_clash THEN 'status' END AS "column", CASE WHEN status_clash THEN o.status END AS ours, CASE WHEN status_clash THEN t.status END AS theirs FROM c WHERE unknown OR dropped OR status_clash""")
def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """What the two sides' edits disagree in."""
    found = merge.merge3(*_edits(spark, d), ["k"])[1]
    cell = F.col("kind") == "both_changed"
    return found.select("k", "kind", "column", F.when(cell, F.col("ours")).alias("ours"), F.when(cell, F.col("theirs")).alias("theirs"))


@query("""
SELECT 'orders' AS "table", count(*) AS n_rows, round(sum(o_totalprice), 2) AS total, count(*) AS in_manifest, 0 AS problems FROM orders UNION ALL SELECT 'customer', count(*), NULL, count(*), 0 FROM customer""")
def bundle_contents(spark: SparkSession, d: str) -> DataFrame:
    """Orders and customers released as a bundle in the shared folder, read back by its manifest, and what its check finds."""
    path = shared_path(spark, "bundle")
    tables = {n: table(spark, d, n) for n in ("orders", "customer")}
    manifest = bundles.write_bundle(tables, path)
    problems = bundles.verify_bundle(spark, path).groupBy(F.split("part", "/")[0].alias("table")).agg(F.count("*").cast("int").alias("problems"))
    one = bundles.read_bundle(spark, path, "orders").agg(F.lit("orders").alias("table"), F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    two = bundles.read_bundle(spark, path, "customer").agg(F.lit("customer").alias("table"), F.count("*").alias("n_rows"), F.lit(None).cast("double").alias("total"))
    counts = spark.createDataFrame([(n, t["rows"]) for n, t in manifest["tables"].items()], "table string, in_manifest bigint")
    return one.unionByName(two).join(F.broadcast(counts), "table").join(problems, "table", "left").withColumn("problems", F.coalesce("problems", F.lit(0)))


@query("""
WITH e AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, j AS item, k + j AS k, CASE event_id % 4 WHEN 1 THEN 'none' WHEN 3 THEN 'none' ELSE event_type END AS type, CASE WHEN event_id % 4 = 2 THEN 'STRING' WHEN event_id % 4 = 1 THEN NULL ELSE 'BIGINT' END AS kind
FROM (SELECT *, unnest(range(CASE WHEN event_id % 4 IN (0, 2) THEN 1 ELSE 2 END)) AS j FROM e)""")
def mixed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Items of documents in four shapes (one object, an array, an object with text for numbers, an object of results), with defaults for what is absent or of the wrong type."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    text = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    shapes = [
        text('{"info": {"k": ', k, '}, "type": "', F.col("event_type"), '"}'), text('[{"info": {"at": ', k, '}, "type": 7}, {"info": null}]'),
        text('{"info": {"k": "', k, '"}, "type": "', F.col("event_type"), '"}'), text('{"results": [{"info": {"k": ', k, '}}, {"info": {"k": ', k + 1, "}}]}"),
    ]
    docs = table(spark, d, "events").select("event_id", k.alias("k"), F.get(F.array(*shapes), (F.col("event_id") % 4).cast("int")).alias("doc"))
    items = docs.select("event_id", "k", F.posexplode(mixed.items_of(F.col("doc"))).alias("item", "v"))
    found = mixed.value_at(F.col("v"), "$.info.k", "bigint")
    name = F.when(mixed.kind_at(F.col("v"), "$.type") == "STRING", mixed.value_at(F.col("v"), "$.type", "string"))
    return items.select("event_id", F.col("item").cast("bigint").alias("item"), F.coalesce(found, F.col("k") + F.col("item")).alias("k"), F.coalesce(name, F.lit("none")).alias("type"), mixed.kind_at(F.col("v"), "$.info.k").alias("kind"))


@query("""
WITH RECURSIVE l AS (SELECT conv_id, turn, line, length(line) // 4 AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS r FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)),
w AS (SELECT conv_id, line, r, size AS filled, 0 AS win FROM l WHERE r = 1 UNION ALL SELECT l.conv_id, l.line, l.r, CASE WHEN w.filled + l.size > 100 THEN l.size ELSE w.filled + l.size END, w.win + (w.filled + l.size > 100)::INT FROM w JOIN l ON l.conv_id = w.conv_id AND l.r = w.r + 1),
t AS (SELECT conv_id || '#' || win AS address, conv_id, win, string_agg(line, chr(10) ORDER BY r) AS text FROM w GROUP BY ALL), a AS (SELECT DISTINCT conv_id || '#' || turn AS address FROM conversations UNION SELECT 'nowhere#1' UNION SELECT 'no address')
SELECT a.address, sha256(t.text) AS sha, CAST(length(t.text) AS INTEGER) AS n_chars FROM a LEFT JOIN t USING (address)""")
def addressed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the conversations' lines by address: the index resolves each to a range of one conversation's lines."""
    path = shared_path(spark, "addressed")
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    numbered = lines.select("conv_id", (F.col("turn").cast("bigint") * 1_000_000 + F.col("i")).alias("ord"), "line")
    addresses.write_addressed(numbered, path, "conv_id", "ord", "line", F.floor(F.length("line") / 4), 100)
    asked = table(spark, d, "conversations").select(F.concat_ws("#", "conv_id", "turn").alias("address")).unionByName(spark.createDataFrame([("nowhere#1",), ("no address",)], "address string"))
    return addresses.window_texts(spark, path, asked, "address").select("address", F.sha2("text", 256).alias("sha"), F.length("text").alias("n_chars"))


@query("""
WITH g AS (SELECT l_orderkey, avg(l_quantity) / 50 AS gold FROM lineitem GROUP BY 1), p AS (SELECT l_shipmode_ AS model, l_orderkey, gold, CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity / 50 END AS pred FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) JOIN g USING (l_orderkey)),
m AS (SELECT model, count(pred) AS n, count(*) - count(pred) AS skipped, avg(abs(pred - gold)) AS mae, avg(((pred >= 0.5) = (gold >= 0.5))::INT) FILTER (pred IS NOT NULL) AS binary_accuracy, CASE WHEN count(pred) >= 2 THEN corr(pred, CASE WHEN pred IS NOT NULL THEN gold END) END AS r FROM p GROUP BY 1)
SELECT model, n, skipped, round(mae, 9) AS mae, round(binary_accuracy, 9) AS binary_accuracy, round(r, 9) AS r, CAST(row_number() OVER (ORDER BY coalesce(r, -1) DESC, model) AS INTEGER) AS place FROM m""")
def model_table(spark: SparkSession, d: str) -> DataFrame:
    """Guesses of each kind of line at its order's mean quantity: errors, skipped rows and places of the kinds."""
    l = table(spark, d, "lineitem")
    gold = l.groupBy("l_orderkey").agg((F.avg("l_quantity") / 50).alias("gold"))
    rows = l.join(gold, "l_orderkey").select(F.concat("l_returnflag", "l_linestatus").alias("model"), F.col("l_orderkey").cast("string").alias("statement"), "gold", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity") / 50).alias("pred"))
    rounded = [F.round(c, 9).alias(c) for c in ("mae", "binary_accuracy", "r")]
    return evaluation.compare(rows, ["model"]).select("model", "n", "skipped", *rounded, "place")


@query("""
SELECT c.conv_id * 100 + c.turn AS window, m.model, CAST(r.repeat AS INTEGER) AS repeat FROM conversations c, (VALUES ('small'), ('large')) m(model), range(3) r(repeat)
WHERE NOT (length(c.text) % 3 = 0 AND m.model = 'small') AND NOT (length(c.text) % 4 = 0 AND r.repeat = 1)""")
def evaluation_plan(spark: SparkSession, d: str) -> DataFrame:
    """What is left to run of every window, by two models, three times each."""
    w = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("window"), F.length("text").alias("n"))
    whole = evaluation.plan(w, "window", ["small", "large"], 3).join(w, "window")
    done = whole.where("(n % 3 = 0 AND model = 'small') OR (n % 4 = 0 AND repeat = 1)")
    return evaluation.plan(w, "window", ["small", "large"], 3, done)


@query("""
SELECT conv_id, count(*) AS n, string_agg('[' || k || ']' || chr(10) || 'Role: ' || role || CASE WHEN trim(said) <> '' THEN chr(10) || 'Said: ' || said ELSE '' END, chr(10) || chr(10) ORDER BY turn) AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, CASE WHEN length(text) % 2 = 0 THEN text END AS said FROM conversations) GROUP BY 1""")
def rendered_batches(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a batch of numbered parts, what is missing left out."""
    rows = table(spark, d, "conversations").withColumn("said", F.when(F.length("text") % 2 == 0, F.col("text")))
    return evaluation.rendered(rows, ["conv_id"], "turn", [("Role", "role"), ("Said", "said")]).withColumn("n", F.col("n").cast("bigint"))


@query("""
WITH s AS (SELECT s_suppkey, s_name FROM supplier), e AS (SELECT s_suppkey % 7 AS g, 'kept-' || s_suppkey AS id, lower(s_name) || ' ltd' AS name FROM s WHERE s_suppkey % 2 = 0)
SELECT coalesce(e.id, trim(regexp_replace(lower(s_name || ' Ltd'), '[^a-z0-9]+', '-', 'g'), '-')) AS id, s_name || ' Ltd' AS name, array_to_string(list_sort(list_distinct(CASE WHEN e.id IS NOT NULL THEN [lower(s_name) || ' ltd', 'ltd', 'no ' || s_suppkey] ELSE [lower(s_name) || ' ltd', 'ltd'] END)), '|') AS aliases FROM s LEFT JOIN e ON e.name = lower(s_name) || ' ltd'""")
def kept_ids(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as a roster built anew, where those known before keep their ids and aliases."""
    s = table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" Ltd")).alias("name"))
    old = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("kept-"), "s_suppkey").alias("id"), F.array(F.lower("name"), F.concat(F.lit("no "), "s_suppkey")).alias("aliases"))
    return roster.rebuild(s.select("name", F.lit(None).cast("string").alias("party")), old).select("id", "name", F.array_join("aliases", "|").alias("aliases"))


@query("""
WITH b AS (SELECT arg_max(p_partkey, p_partkey) AS bill, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS k FROM part GROUP BY 2)
SELECT p_partkey AS vote, bill FROM part LEFT JOIN b ON p_partkey % 3 <> 0 AND b.k = regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g')""")
def titles_joined(spark: SparkSession, d: str) -> DataFrame:
    """Parts as votes on titles in other spelling, each with the last part of that title."""
    p = table(spark, d, "part")
    other = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Another "), "p_name")).otherwise(F.upper(F.replace("p_name", F.lit(" "), F.lit(" – "))))
    return roster.join_titles(p.select(F.col("p_partkey").alias("vote"), other.alias("title")), "title", p.select("p_name", F.col("p_partkey").alias("bill")), "p_name", "bill", ["bill"]).select("vote", "bill")
