"""Queries that apply the operators, with production parameters, to whole tables."""

from __future__ import annotations

import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, context_tree, decontaminate, exact_dedup, language, line_dedup, merkle, paragraph_sketch, pii, simhash, token_alignment, token_store, toxicity
from quillspark.llm.common import crc_bucket, documents, limit_batches

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID = 1
#: Setting that holds the secret key of the pseudonyms; without it each run draws a key of its own.
PII_KEY = "spark.quillspark.pii.key"


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    read = token_store.encode_to_store(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), END_ID)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("key")


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_documents(documents(spark, sf_dir), modulus=5, held_out=1)


def op4_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_sketch.fingerprint_versions(documents(spark, sf_dir))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.learn(docs, modulus=3, held_out=1)
    held_out = (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out")
    return docs.select("doc_id", held_out, language.identify(model, docs).alias("found")).select("doc_id", "held_out", "found.*")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(PII_KEY, None)
    return pii.pseudonymise_documents(documents(spark, sf_dir), key.encode() if key else secrets.token_bytes(32))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = toxicity.learn(docs.where(~held_out), labels.where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.assess(model, docs).alias("found"))
    return scored.select("doc_id", "held_out", "found.score", (F.col("found.score") >= 0.5).cast("int").alias("predicted"), "found.offending")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedupe_lines(documents(spark, sf_dir)).select("doc_id", "text", "removed_lines", "earlier")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    coded = bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), words_in_shingle=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizers = token_alignment.Tokenizers(public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER))
    aligned = token_alignment.align(documents(spark, sf_dir), tokenizers)
    found = aligned.withColumn("groups_sha256", F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))).drop("groups")
    return token_alignment.weigh_links(found).drop("links")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.mark_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    claimed = merkle.leaf(n_chars=F.col("n_chars") + struck.cast("bigint"))
    proved = merkle.prove(docs, claimed=F.when(struck, claimed))
    folded = merkle.fold(F.coalesce("claimed", "leaf"), F.col("proof"))
    return proved.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_store, op2_decontaminate, op3_context_tree, op4_paragraph_sketch, op5_language, op6_pii, op7_bpe, op8_simhash, op9_toxicity, op10_line_dedup, op11_token_alignment, op12_exact_dedup, op13_merkle)
    return {f.__name__: f for f in found}


#: Of equal texts the row with the largest doc_id stays.
OP12_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, digest AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS digest FROM documents)
WINDOW g AS (PARTITION BY digest)
"""

#: Trees level by level; crc32 bit by bit over the decimal digits (reflected polynomial 0xEDB88320).
OP13_SQL = """
WITH RECURSIVE
docs AS (
    SELECT *, xor(list_reduce(list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT),
        lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: xor(v >> 1, (v & 1) * 3988292384)), 4294967295), 4294967295) % 7 = 0 AS struck
    FROM documents),
parts AS (
    SELECT doc_id, lang, struck,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS size, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS other_size,
        coalesce(strlen(text) || ':' || text, '-') AS body
    FROM docs),
leaves AS (
    SELECT doc_id, lang, sha256(head || size || body) AS leaf, sha256(head || CASE WHEN struck THEN other_size ELSE size END || body) AS claimed,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
    FROM parts),
nodes AS (
    SELECT lang, 0 AS level, pos, n, leaf AS h FROM leaves
    UNION ALL
    SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (SELECT lang, level AS depth, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place, count(*) OVER () AS langs FROM nodes WHERE n = 1),
tops AS (
    SELECT 0 AS level, place AS pos, langs AS n, subroot AS h FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
top AS (SELECT h AS root, level AS height FROM tops WHERE n = 1),
steps AS (
    SELECT l.doc_id, l.lang, s.level, s.h AS sibling, (l.pos >> s.level) & 1 AS is_right
    FROM leaves l JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.n > 1 AND s.pos = xor(l.pos >> s.level, 1)
    UNION ALL
    SELECT l.doc_id, l.lang, r.depth + s.level, s.h, (r.place >> s.level) & 1
    FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN tops s ON s.n > 1 AND s.pos = xor(r.place >> s.level, 1)),
proofs AS (SELECT doc_id, sha256(string_agg(sibling, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY doc_id),
folds AS (
    SELECT l.doc_id, 0 AS level, r.depth + top.height AS depth, l.claimed AS h FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang, top
    UNION ALL
    SELECT f.doc_id, f.level + 1, f.depth, sha256(CASE WHEN s.sibling IS NULL THEN f.h WHEN s.is_right = 1 THEN s.sibling || f.h ELSE f.h || s.sibling END)
    FROM folds f LEFT JOIN steps s ON s.doc_id = f.doc_id AND s.level = f.level WHERE f.level < f.depth)
SELECT l.doc_id, l.leaf, r.subroot, top.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = top.root AS verified
FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN folds f ON f.doc_id = l.doc_id AND f.level = f.depth LEFT JOIN proofs p ON p.doc_id = l.doc_id, top
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_exact_dedup": OP12_SQL, "op13_merkle": OP13_SQL}
