"""Queries of what is read from files and written to them: each lays a table's rows out in a form and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import evidence, incremental, mentions
from quillspark.operators.ranking import shared_path
from quillspark.plans.registry import query, table
from quillspark.sources import files, listings, sinks


@query("""
SELECT c_custkey AS id, c_name AS title, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0""")
def strict_lines(spark: SparkSession, d: str) -> DataFrame:
    """Customers of two of three files of JSON lines, read strictly as a list of paths."""
    path = shared_path(spark, "lines")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    for k in range(3):
        sinks.write_jsonl(rows.where(F.col("id") % 3 == k), f"{path}/{k}")
    return files.read_jsonl(spark, (f"{path}/1", f"{path}/2"), "id bigint, title string, segment string, balance double")


@query("""
SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_custkey % 7 <> 3""")
def tolerant_lines(spark: SparkSession, d: str) -> DataFrame:
    """Customers of JSON lines some of which are torn, and of later lines that were appended."""
    path = shared_path(spark, "torn")
    record = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")))
    lines = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 3, F.substring(record, 1, 14)).otherwise(record).alias("value"))
    lines.where("c_custkey % 2 = 0").select("value").write.text(path)
    lines.where("c_custkey % 2 = 1").select("value").write.mode("append").text(path)
    return files.read_jsonl(spark, path, "id bigint, title string", strict=False)


@query("""
SELECT 'r' || (n_regionkey * 2 + (n_nationkey % 2)) AS source, n_nationkey AS id, n_name AS name, CAST(row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 2 ORDER BY n_nationkey) - 1 AS INTEGER) AS ord FROM nation""")
def arrays_or_lines(spark: SparkSession, d: str) -> DataFrame:
    """Nations of files that hold an array or a record a line, told apart by their first sign, with their places."""
    path = shared_path(spark, "either")
    r = table(spark, d, "nation").select((F.col("n_regionkey") * 2 + F.col("n_nationkey") % 2).alias("g"), F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("r"))
    whole = r.groupBy("g").agg(F.array_sort(F.collect_list("r")).alias("rs"))  # a region's nations
    array, lines = F.to_json("rs"), F.array_join(F.transform("rs", lambda x: F.to_json(x)), "\n")
    whole.select(F.concat(F.lit("r"), "g").alias("source"), F.when(F.col("g") % 2 == 0, F.concat(F.lit(" \n"), array)).otherwise(F.concat(lines, F.lit("\n{torn"))).alias("value")).repartition("source").write.partitionBy("source").text(path)
    found = files.read_either(spark, f"{path}/*", "id bigint, name string")
    return found.select(F.regexp_extract("file", "source=([^/]+)", 1).alias("source"), "id", "name", "ord")


@query("""
SELECT doc_id, quality::VARCHAR || ', "' || toxic || '"' || chr(10) || 'end' AS note, CASE WHEN toxic = 1 THEN NULL ELSE quality END AS quality FROM labels""")
def labels_as_csv(spark: SparkSession, d: str) -> DataFrame:
    """Labels through a CSV file with commas, quotation marks, line feeds and missing values."""
    path = shared_path(spark, "csv")
    rows = table(spark, d, "labels").select("doc_id", F.concat(F.col("quality").cast("string"), F.lit(', "'), F.col("toxic").cast("string"), F.lit('"\nend')).alias("note"), F.when(F.col("toxic") != 1, F.col("quality")).alias("quality"))
    sinks.write_csv(rows, path)
    return files.read_csv(spark, path, "doc_id bigint, note string, quality bigint")


@query("""
SELECT CAST(strlen(t) + 1 AS BIGINT) AS bytes, CAST(length(t) - length(replace(t, chr(10), '')) + 1 AS BIGINT) AS lines, sha256(t || chr(10)) AS sha256, length(t) + 1 AS n_chars
FROM (SELECT string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)""")
def text_files(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as text files: their manifest, and the length of each as a whole text."""
    path = shared_path(spark, "texts")
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))), lambda x: x["line"]), "\n")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    one = table(spark, d, "conversations").repartition(parts, "conv_id").groupBy("conv_id").agg(t.alias("value"))
    sinks.write_texts(one, path)
    manifest = files.manifest(spark, path)
    whole = files.read_texts(spark, path).select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), F.sha2("value", 256).alias("sha256"), F.length("value").alias("n_chars"))
    return manifest.join(whole, ["file", "sha256"]).select("bytes", "lines", "sha256", "n_chars")


@query("""
WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, value FROM events), p AS (SELECT * FROM e WHERE day >= '2024-01-04' AND day[1:7] <= '2024-01' AND event_id % 5 <> 0 AND day[9:10]::INT % 3 <> 0),
f AS (SELECT * FROM e WHERE event_id % 5 = 1 AND day NOT IN (SELECT day FROM p))
SELECT day, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT * FROM p UNION ALL SELECT * FROM f) GROUP BY 1""")
def days_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Events of a range of days, and the days that are missing there whole from another source."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "value")
    primary = files.date_range(e.where("event_id % 5 <> 0 AND int(substring(day, 9, 2)) % 3 <> 0"), "day", "2024-01-04", "2024-01")
    found = files.with_fallback(primary, e.where("event_id % 5 = 1"), "day")
    return found.groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(r"""
WITH u AS (SELECT page_id, url, strftime(TIMESTAMP '2023-12-01' + to_hours(page_id * 7 % 2000), '%Y%m%d%H%M%S') AS ts FROM pages), v AS (SELECT url, ts FROM u UNION ALL SELECT replace(replace(url, 'https://', 'http://www.'), '?', ':80/?'), strftime(strptime(ts, '%Y%m%d%H%M%S') + INTERVAL 30 DAYS, '%Y%m%d%H%M%S') FROM u)
SELECT regexp_replace(regexp_replace(regexp_replace(lower(url), '^http:', 'https:'), '://www\.', '://'), '(:80)?/*([?#].*)?$', '') AS url, min(ts) AS ts FROM v WHERE ts >= '20240101' GROUP BY 1""")
def earliest_captures(spark: SparkSession, d: str) -> DataFrame:
    """Earliest capture of each page's canonical address since a day."""
    at = lambda c: F.date_format(c, "yyyyMMddHHmmss")
    taken = F.timestamp_add("HOUR", F.col("page_id") * 7 % 2000, F.lit("2023-12-01").cast("timestamp"))
    p = table(spark, d, "pages").select("url", taken.alias("t"))
    again = p.select(F.replace(F.replace("url", F.lit("https://"), F.lit("http://www.")), F.lit("?"), F.lit(":80/?")).alias("url"), at(F.timestamp_add("DAY", F.lit(30), F.col("t"))).alias("ts"))
    return files.archive_candidates(p.select("url", at("t").alias("ts")).unionByName(again), "20240101")


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def streamed_months(spark: SparkSession, d: str) -> DataFrame:
    """Orders appended month by month from a listing: the second run takes what came since, a third one nothing."""
    path = shared_path(spark, "months")
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    first = orders.agg(F.min("month")).first()[0]
    cut = f"{int(first[:4]) + 2}{first[4:]}"
    kept = ["o_orderkey", "o_totalprice"]
    for part in (orders.where(F.col("month") <= cut), orders.where(F.col("month") > cut), None):
        if part is not None:
            listings.write_listing(part.select(*kept, "month"), f"{path}/listing", F.col("month"), [F.col("o_orderkey")], 1000)
        stream = listings.stream_listing(spark, f"{path}/listing")
        stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/offsets").trigger(once=True).start().awaitTermination()
    rows = spark.read.schema(listings.SCHEMA).parquet(f"{path}/rows")
    return rows.groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum(F.get_json_object("record", "$.o_totalprice").cast("double")), 2).alias("total"))


#: Tiers and required fields of the attributes below.
REGISTRY = {"focus": (evidence.TEXT, ()), "reply": (evidence.TEXT, ("to",)), "forecast": (evidence.SEARCH, ("criterion", "due")), "vote": (evidence.RECORD, ("topic",))}


@query("""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), b AS (SELECT item_id, text, length(text) AS n, ['focus', 'reply', 'forecast', 'vote'][item_id % 4 + 1] AS a FROM benchmark),
v AS (SELECT b.*, exists(SELECT 1 FROM d WHERE contains(d.t, lower(b.text))) AS verbatim FROM b),
r AS (SELECT *, CASE WHEN NOT verbatim THEN 'quote:missing' WHEN NOT (regexp_matches(substr(text, 1, 1), '[\\p{Lu}"''“‘(]') AND regexp_matches(text, '[.!?"''”’)]$')) THEN 'quote:mid_sentence'
  WHEN a = 'reply' AND n % 2 = 0 THEN 'reply:missing_to' WHEN a = 'forecast' AND n % 3 = 0 THEN 'forecast:missing_due' WHEN a IN ('focus', 'reply') AND n % 5 = 0 THEN a || ':no_score' END AS reason FROM v)
SELECT item_id, a AS attribute, CASE a WHEN 'forecast' THEN 'search' WHEN 'vote' THEN 'record' ELSE 'text' END AS tier, reason, CASE WHEN reason IS NULL AND a = 'forecast' AND n % 5 = 0 THEN 'forecast:no_prior' END AS remark,
  CASE WHEN reason IS NULL AND a IN ('focus', 'reply') THEN least(1.0, n / 100.0) END AS score, CASE WHEN reason IS NULL AND a = 'forecast' AND n % 5 <> 0 THEN least(1.0, n / 100.0) END AS prior FROM r""")
def tiered_gate(spark: SparkSession, d: str) -> DataFrame:
    """The quality gate by tiers and required fields, over the items as statements and the documents as their source."""
    n = F.length("text")
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("statement"), F.get(F.array(*map(F.lit, REGISTRY)), F.col("item_id") % 4).alias("attribute"), F.when(n % 5 != 0, (n / 100.0).cast("string")).otherwise("?").alias("score"),
        F.create_map(F.lit("to"), F.when(n % 2 == 1, "it"), F.lit("criterion"), F.lit("c"), F.lit("due"), F.when(n % 3 == 0, "").otherwise("2030"), F.lit("topic"), F.lit("t")).alias("fields"), F.lit(None).cast("string").alias("prior_score"))
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    hits = mentions.find_mentions(docs, "doc_id", ["t"], items.select("item_id", F.lower("statement").alias("s")), "item_id", "s", folded=False).select("item_id").distinct()
    classed = items.join(hits.withColumn("quote_class", F.lit("verbatim")), "item_id", "left").withColumn("quote_class", F.coalesce("quote_class", F.lit("missing")))
    return evidence.gated(classed, REGISTRY).select("item_id", "attribute", "tier", "reason", "remark", F.col("gated_score").alias("score"), F.col("gated_prior").alias("prior"))


@query("""
WITH o AS (SELECT o_custkey AS k, o_orderstatus AS a, list(struct_pack(o := o_orderkey, p := o_totalprice) ORDER BY o_orderkey) AS l FROM orders GROUP BY ALL)
SELECT k, a AS attribute, CAST(i - 1 AS INTEGER) AS idx, l[i].o AS o, l[i].p AS p FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM o)""")
def example_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as a map of status to examples, and its examples as rows with their places."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), "o_orderstatus").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("o"), F.col("o_totalprice").alias("p")))).alias("l"))
    windows = o.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "l"))).alias("m"))
    return evidence.explode_examples(windows, ["k"], "m")


@query("""
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 4 <> 1""")
def merged_lines(spark: SparkSession, d: str) -> DataFrame:
    """Saved rows whose keys a new file replaces wholesale, written and read back."""
    path = shared_path(spark, "merged")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status")).where("k % 4 <> 1")
    sinks.write_merged(o.where("k % 3 <> 0 OR k % 2 = 0"), o.where("k % 3 = 0").withColumn("status", F.lit("new")), ["k"], path)
    left = incremental.todo(o, files.read_jsonl(spark, path, "k bigint, status string"), ["k"])
    return files.read_jsonl(spark, path, "k bigint, status string").unionByName(left)
