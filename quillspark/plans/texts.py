"""Queries of text cleaning, matching and the scorer's boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import evidence, match, mentions, packing, scorer, segments
from quillspark.plans.registry import query, table
from quillspark.sources import html

#: Lines of no content.
BOILERPLATE = "licen[sc]ed under|all rights reserved|cookie|subscribe|click here|privacy policy"


@query("""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ') AS text FROM documents""")
def tidy_text(spark: SparkSession, d: str) -> DataFrame:
    """Tidied texts."""
    return table(spark, d, "documents").select("doc_id", T.tidy(F.col("text")).alias("text"))


@query(f"""
SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(lower(x), '{BOILERPLATE}')), chr(10)), 'https?://[^ \\n]+', '', 'g') AS text FROM documents""")
def strip_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Texts without boilerplate lines and URLs."""
    return table(spark, d, "documents").select("doc_id", T.without_lines(F.col("text"), BOILERPLATE).alias("text"))


@query("""
WITH k AS (SELECT doc_id, source, regexp_replace(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')), '[0-9][0-9,.]*', '#', 'g') AS key FROM documents)
SELECT min(doc_id) AS doc_id, sha256(key) AS template, count(*) AS n, count(DISTINCT source) AS sources FROM k GROUP BY key""")
def template_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First document of each template, and how many share it."""
    k = table(spark, d, "documents").select("doc_id", "source", F.sha2(T.template_key(F.col("text")), 256).alias("template"))
    return k.groupBy("template").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("""
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')) AS key FROM documents) GROUP BY key""")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First of each group of equal texts, case and white space aside."""
    k = table(spark, d, "documents").select("doc_id", F.sha2(F.lower(T.collapse(F.col("text"))), 256).alias("key"))
    return k.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("key")


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), f AS (SELECT doc_id, len(l) AS n_lines, list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]) AS k FROM l)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_lines - len(k) AS BIGINT) AS dropped, array_to_string(k, chr(10)) AS text FROM f WHERE len(k) < n_lines""")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents with lines that repeat the one before, without them."""
    l = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("l")).withColumn("k", segments.changed_lines(F.col("l")))
    return l.where(F.size("k") < F.size("l")).select("doc_id", F.size("l").cast("bigint").alias("n_lines"), (F.size("l") - F.size("k")).cast("bigint").alias("dropped"), F.array_join("k", "\n").alias("text"))


@query("""
WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' '), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents),
p AS (SELECT doc_id, s, 0 AS i, '' AS open, CAST(NULL AS VARCHAR) AS passage FROM s
  UNION ALL SELECT doc_id, s, i + 1, CASE WHEN length(j) >= 120 THEN '' ELSE j END, CASE WHEN length(j) BETWEEN 120 AND 600 THEN j END FROM (SELECT *, CASE WHEN open = '' THEN s[i + 1] ELSE open || ' ' || s[i + 1] END AS j FROM p WHERE i < len(s)))
SELECT doc_id, i AS last_sentence, substr(sha256(passage), 1, 16) AS passage_id, length(passage) AS n_chars FROM p WHERE passage IS NOT NULL""")
def passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 120 to 600 characters of consecutive sentences."""
    found = table(spark, d, "documents").select("doc_id", F.explode(packing.passages(T.sentences(F.col("text")))).alias("p"))
    return found.select("doc_id", F.col("p.last").alias("last_sentence"), T.score_key(F.col("p.text")).alias("passage_id"), F.length("p.text").cast("bigint").alias("n_chars"))


@query("""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)), t AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8))
SELECT doc_id, item_id, count(*) AS shared FROM s JOIN t USING (s) GROUP BY 1, 2""")
def shingle_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Documents and benchmark items that share runs of eight words."""
    return match.shared_shingles(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", 8)


_KEY = "regexp_replace(lower(trim(regexp_replace(replace(translate({0}, '‘’‚“”„–— ', '''''''\"\"\"-- '), '…', '...'), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')), '^[ .,;:!?''\"()-]+|[ .,;:!?''\"()-]+$', '', 'g')"


@query(f"""
WITH d AS (SELECT doc_id, {_KEY.format('text')} AS t FROM documents), b AS (SELECT item_id, {_KEY.format('text')} AS q FROM benchmark), h AS (SELECT item_id, count(*) AS n, min(doc_id) AS first_doc FROM b JOIN d ON contains(t, q) GROUP BY 1)
SELECT b.item_id, CASE WHEN n > 0 THEN 'verbatim' ELSE 'missing' END AS class, coalesce(n, 0) AS n_docs, first_doc FROM b LEFT JOIN h USING (item_id)""")
def quote_audit(spark: SparkSession, d: str) -> DataFrame:
    """Which quotes stand verbatim in a source, where first and how often."""
    quotes = table(spark, d, "benchmark")
    hits = match.containing(table(spark, d, "documents"), quotes, "doc_id", "item_id").groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return quotes.select("item_id").join(hits, "item_id", "left").select("item_id", F.when(F.col("n_docs") > 0, "verbatim").otherwise("missing").alias("class"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "first_doc")


@query("""
WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS w FROM documents), b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS w FROM benchmark),
s AS (SELECT item_id, doc_id, len(list_intersect(b.w, w.w)) AS overlap FROM b, w), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rn FROM s WHERE overlap >= 5)
SELECT b.item_id, r.doc_id, CAST(r.overlap AS BIGINT) AS overlap FROM b LEFT JOIN r ON b.item_id = r.item_id AND rn = 1""")
def best_window_match(spark: SparkSession, d: str) -> DataFrame:
    """The document that shares most words with each item, five at least, the first of equals."""
    distinct = lambda df, key: df.select(key, F.explode(F.array_distinct(T.words(F.col("text")))).alias("w"))
    items = table(spark, d, "benchmark")
    pairs = distinct(table(spark, d, "documents"), "doc_id").join(distinct(items, "item_id"), "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("overlap")).where("overlap >= 5")
    best = pairs.groupBy("item_id").agg(F.max(F.struct("overlap", (-F.col("doc_id")).alias("i"))).alias("b"))
    return items.select("item_id").join(best, "item_id", "left").select("item_id", (-F.col("b.i")).alias("doc_id"), F.col("b.overlap").alias("overlap"))


@query("""
WITH a AS (SELECT item_id, lower(array_to_string(string_split_regex(trim(text), '[ \\t\\n\\r\\f]+')[1:4], ' ')) AS alias FROM benchmark)
SELECT d.doc_id, a.item_id FROM documents d JOIN a ON contains(lower(trim(regexp_replace(d.text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')), a.alias)""")
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Documents that mention an entity's alias (an item's first four words)."""
    alias = F.lower(F.array_join(F.slice(F.split(F.trim("text"), r"[ \t\n\r\f]+"), 1, 4), " "))
    aliases = table(spark, d, "benchmark").select("item_id", alias.alias("alias"))
    docs = table(spark, d, "documents").select("doc_id", F.lower(T.collapse(F.col("text"))).alias("t"))
    return mentions.find_mentions(docs, "doc_id", ["t"], aliases, "item_id", "alias", folded=False).select("doc_id", "item_id")


@query("""
WITH t AS (SELECT DISTINCT p_name AS title, list_sort(list_distinct(string_split(p_name, ' '))) AS t FROM part),
q AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') WHEN p_partkey % 3 = 1 THEN string_split(p_name, ' ')[1] ELSE p_name || ' extra' END AS query FROM part), r AS (SELECT query, list_sort(list_distinct(string_split(query, ' '))) AS q FROM q),
c AS (SELECT query, title, CASE WHEN q = t THEN 1 WHEN len(list_intersect(q, t)) IN (len(q), len(t)) THEN 2 WHEN len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))) >= 0.6 THEN 3 END AS tier, CASE WHEN q = t OR len(list_intersect(q, t)) IN (len(q), len(t)) THEN 1.0 ELSE len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))) END AS s FROM r, t WHERE len(list_intersect(q, t)) > 0),
k AS (SELECT *, rank() OVER (PARTITION BY query ORDER BY tier, s DESC) AS rk FROM c WHERE tier IS NOT NULL), o AS (SELECT query, min(title) AS title, min(tier) AS tier FROM k WHERE rk = 1 GROUP BY query HAVING count(*) = 1)
SELECT r.query, o.title, CASE tier WHEN 1 THEN 'equal' WHEN 2 THEN 'contained' WHEN 3 THEN 'similar' END AS via FROM r LEFT JOIN o USING (query)""")
def title_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Reordered, shortened and lengthened titles found in the vocabulary, where one fits best."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"))
    w, k = F.split("title", " "), F.col("p_partkey") % 3
    queries = p.select(F.when(k == 0, F.array_join(F.reverse(w), " ")).when(k == 1, F.get(w, F.lit(0))).otherwise(F.concat("title", F.lit(" extra"))).alias("query"))
    return match.resolve_titles(queries, "query", p, "title")


@query("""
WITH r AS (SELECT s_suppkey AS id, lower(s_name) AS key FROM supplier), m AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'Hon ' || upper(s_name) WHEN s_suppkey % 3 = 1 THEN s_name || ' (Acting)' ELSE s_name || ' Jr' END AS mention, CASE WHEN s_suppkey % 3 = 2 THEN lower(s_name) || ' jr' ELSE lower(s_name) END AS key FROM supplier),
f AS (SELECT key, min(id) AS id FROM r GROUP BY 1 HAVING count(DISTINCT id) = 1), l AS (SELECT string_split(key, ' ')[-1] AS key, min(id) AS id FROM r GROUP BY 1 HAVING count(DISTINCT id) = 1)
SELECT mention, coalesce(f.id, l.id) AS id, CASE WHEN f.id IS NOT NULL THEN 'name' WHEN l.id IS NOT NULL THEN 'surname' END AS via FROM m LEFT JOIN f ON f.key = m.key LEFT JOIN l ON l.key = string_split(m.key, ' ')[-1]""")
def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Names with titles and remarks resolved to suppliers."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 3
    mentions = s.select(F.when(k == 0, F.concat(F.lit("Hon "), F.upper("s_name"))).when(k == 1, F.concat("s_name", F.lit(" (Acting)"))).otherwise(F.concat("s_name", F.lit(" Jr"))).alias("mention"))
    return match.resolve_names(mentions, "mention", s, "s_suppkey", "s_name")


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host, length(url) - length(replace(url, '/', '')) - 2 AS depth, regexp_matches(url, '^https') AS secure FROM pages""")
def url_fields(spark: SparkSession, d: str) -> DataFrame:
    """Host, depth and scheme of page URLs."""
    return table(spark, d, "pages").select("page_id", T.host(F.col("url")).alias("host"), (F.length("url") - F.length(F.replace("url", F.lit("/"), F.lit(""))) - 2).cast("bigint").alias("depth"), F.col("url").startswith("https").alias("secure"))


@query(r"""
WITH a AS (SELECT page_id, url, html, regexp_replace(html, '(?s)<title>.*?</title>|<style.*?</style>|<script.*?</script>|<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->|<![^>]*>', '', 'g') AS h FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(h, '</?(p|br|li|h1|div|article)( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t, regexp_replace(regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g') AS h1 FROM a),
u AS (SELECT page_id, url, replace(replace(t, '&quot;', '"'), '&amp;', '&') AS t, replace(replace(h1, '&quot;', '"'), '&amp;', '&') AS h1 FROM b)
SELECT page_id, url, trim(regexp_replace(h1, '\s+', ' ', 'g')) AS headline, CAST(NULL AS VARCHAR) AS author, CAST(NULL AS VARCHAR) AS date, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS content FROM u""")
def page_articles(spark: SparkSession, d: str) -> DataFrame:
    """Headline, author, date and content of pages."""
    return html.articles(table(spark, d, "pages"))


@query(r"""
WITH h AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS base, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages), u AS (SELECT page_id, base || replace(unnest(l), '&amp;', '&') AS link, generate_subscripts(l, 1) AS i FROM h),
f AS (SELECT page_id, link, min(i) AS i FROM u GROUP BY ALL) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS position, link FROM f""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages, absolute, once each and in order."""
    return html.links(table(spark, d, "pages"))


@query(f"""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), b AS (SELECT item_id, text, lower(text) AS q, CASE WHEN item_id % 4 <> 0 THEN least(1.0, length(text) / 300.0) END AS score FROM benchmark),
f AS (SELECT item_id, min(doc_id) AS doc_id FROM b JOIN d ON contains(d.t, b.q) GROUP BY 1), c AS (SELECT b.*, f.doc_id FROM b LEFT JOIN f USING (item_id))
SELECT coalesce(CASE WHEN c.doc_id IS NULL THEN 'not_verbatim' WHEN NOT regexp_matches(substr(c.text, 1, 1), '[A-ZÀ-Þ"(]') THEN 'cut_start' WHEN NOT regexp_matches(c.text, '[.!?"]$') THEN 'cut_end' WHEN score IS NULL THEN 'no_score' END, 'accepted') AS reason, count(*) AS n, min(item_id) AS first_item FROM c GROUP BY 1""")
def gate_rejects(spark: SparkSession, d: str) -> DataFrame:
    """How many statements pass the quality gate, and why the others don't."""
    items = table(spark, d, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 4 != 0, F.least(F.lit(1.0), F.length("text") / 300.0)).alias("score"))
    found = match.containing(table(spark, d, "documents"), items, "doc_id", "item_id").select("item_id").distinct().withColumn("verbatim", F.lit(True))
    gated = items.join(found, "item_id", "left").withColumn("reason", evidence.reject_reason(F.coalesce("verbatim", F.lit(False)), F.col("text"), F.col("score")))
    return gated.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.min("item_id").alias("first_item"))


@query(r"""
WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, E' \t\n\r\f')), lambda x: x <> '')) AS statement, unnest(range(len(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, E' \t\n\r\f')), lambda x: x <> '')))) AS i FROM documents),
w AS (SELECT *, list_filter(string_split_regex(lower(statement), '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM s)
SELECT doc_id AS window_id, 'focus' AS attribute, CAST(2 * i AS INTEGER) AS idx, statement, round_even(least(1.0, len(w) / 40), 6) AS score FROM w
UNION ALL SELECT doc_id, 'variety', CAST(2 * i + 1 AS INTEGER), statement, CASE WHEN len(w) > 2 THEN round_even(len(list_distinct(w)) / len(w), 6) END FROM w""")
def scored_documents(spark: SparkSession, d: str) -> DataFrame:
    """Attribute scores of documents from the offline scorer."""
    return scorer.score(table(spark, d, "documents").select(F.col("doc_id").alias("window_id"), "text"), scorer.RuleScorer())


@query("""
WITH s AS (SELECT l_suppkey AS id, l_returnflag AS attr, avg(l_discount) AS score, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT id, s_name AS name, round(max(score) FILTER (attr = 'A'), 10) AS "A", max(n) FILTER (attr = 'A') AS "A_n", round(max(score) FILTER (attr = 'N'), 10) AS "N", max(n) FILTER (attr = 'N') AS "N_n", round(max(score) FILTER (attr = 'R'), 10) AS "R", max(n) FILTER (attr = 'R') AS "R_n" FROM s JOIN supplier ON id = s_suppkey GROUP BY 1, 2""")
def published_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Wide card of each entity: a score and its number for every attribute."""
    long = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("attr")).agg(F.round(F.avg("l_discount"), 10).alias("score"), F.count("*").alias("n"))
    return evidence.wide_scores(long, ["A", "N", "R"]).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "id")


@query("""
WITH w AS (SELECT lang, source, n_chars // 4 AS t FROM documents) SELECT source, count(*) AS parts, CAST(sum(t) AS BIGINT) AS tokens, round(100.0 * sum(t) FILTER (lang = 'en') / sum(t), 6) AS english_share, CAST(round_even(sum(t) * 4 / 6.0, 0) AS BIGINT) AS words_estimate FROM w GROUP BY 1""")
def token_shares(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by source and how many are English."""
    w = table(spark, d, "documents").select("lang", "source", F.floor(F.col("n_chars") / 4).alias("t"))
    return w.groupBy("source").agg(F.count("*").alias("parts"), F.sum("t").alias("tokens"), F.round(100.0 * F.sum(F.when(F.col("lang") == "en", F.col("t"))) / F.sum("t"), 6).alias("english_share"), F.bround(F.sum("t") * 4 / 6.0).cast("bigint").alias("words_estimate"))
