import random
import zlib
from hashlib import sha256

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, merkle, queries
from tests.compare import connect, rows
from tests.conftest import SF
from tests.llm.helpers import DOC, docs_of


@pytest.mark.parametrize("name", ["op12_exact_dedup", "op13_merkle"])
def test_query_equals_sql(spark, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), connect(SF).execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(pd.read_parquet(f"{SF}/documents.parquet")) and rows(got) == rows(want)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_heavy_and_light_digests_agree_with_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["Heavy ONE"] * 300 + ["heavy two", "HEAVY TWO"] * 60 + [f"Text {rng.randint(0, 90)} Ä" for _ in range(400)] + [None, "", None] + ["x" * 300_000 + "Y", "X" * 300_000 + "y"]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    for share in (1, 8, 1 << 12):  # nothing heavy, some heavy, all repeated ones heavy
        monkeypatch.setattr(exact_dedup, "SHARE", share)
        got = {r["doc_id"]: r for r in exact_dedup.mark_duplicates(docs_of(spark, docs)).collect()}
        groups = {}
        for i, t in docs:
            groups.setdefault(lowered(t), []).append(i)
        assert len(got) == len(docs)
        for i, t in docs:
            own = groups[lowered(t)]
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], bytes(got[i]["digest"])) == (max(own), len(own), i == max(own), sha256(lowered(t).encode()).digest())


def test_summary_names_every_heavy_digest(spark):
    heavy = [f"heavy {i}" for i in range(20)]
    docs = spark.createDataFrame([(i, heavy[i // 2 % 20] if i % 2 else f"light {i}") for i in range(4000)], "doc_id bigint, text string").repartition(13)
    found = exact_dedup.heavy_digests(exact_dedup.digests(docs), 4000).collect()
    assert {bytes(r["digest"]) for r in found} == {sha256(t.encode()).digest() for t in heavy} and {r["group_size"] for r in found} == {100}


def test_dedup_of_repeated_ids_nulls_and_clashing_columns(spark):
    rows_ = [(3, "a", 1), (3, "A", 2), (None, "a", 3), (None, "b", 4), (None, "B", 5), (7, None, 6), (2, "", 7)]
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string, digest int").selectExpr("*", "digest AS row", "digest AS h", "digest AS kept", "digest AS k", "digest AS m", "digest AS `odd.name`")
    marked = exact_dedup.mark_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in marked) == sorted([("3", "3", 3), ("3", "3", 3), ("None", "3", 3), ("None", "None", 2), ("None", "None", 2), ("7", "7", 2), ("2", "7", 2)])
    assert sum(r["kept"] for r in marked) == 3
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted((str(r["doc_id"]), lowered(r["text"])) for r in left.collect()) == [("3", "a"), ("7", ""), ("None", "b")]
    assert exact_dedup.mark_duplicates(docs_of(spark, [])).count() == 0 and exact_dedup.deduplicate(docs_of(spark, [])).count() == 0


# Merkle manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_paths(leaves):
    """Root and siblings (side, digest) of each leaf, by whole levels."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            if (i ^ 1) < len(level):
                paths[k].append(level[i ^ 1])
        at = [i >> 1 for i in at]
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def plain_manifest(docs):
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    made = [(d, h(*(part(d[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")))) for d in docs]
    first = lambda x: (x is not None, x or 0)
    langs = sorted({d["lang"] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((x for x in made if x[0]["lang"] == lang), key=lambda x: (first(x[0]["doc_id"]), x[1]))
        root, paths = plain_paths([leaf for _, leaf in own])
        trees[lang] = root, own, paths
    root, upper = plain_paths([trees[x][0] for x in langs])
    return sorted((str(d["doc_id"]), leaf, subroot, root, h(*path, *up)) for lang, up in zip(langs, upper) for subroot, own, paths in [trees[lang]] for (d, leaf), path in zip(own, paths))


@pytest.mark.parametrize("n", [*range(1, 20), 63, 64, 65])
@pytest.mark.parametrize("band", [1, 2, 3, 7])
def test_fractal_paths_equal_plain_ones(n, band):
    leaves = [sha256(bytes([i])).digest() for i in range(n)]
    root, paths = plain_paths([x.hex() for x in leaves])
    for top in (merkle.height(n, 99), merkle.height(n, 99) + 2):
        got = list(merkle.traverse(leaves, top, band))
        assert [[s[1:].hex() for s in steps if s != merkle.ALONE] for steps in got] == paths
        assert all(len(steps) == top for steps in got)
        for _ in range(top - merkle.height(n, 99)):
            root = h(root)
        assert merkle.block_root(leaves, top).hex() == root


def test_traversal_holds_little(monkeypatch):
    held = []
    keep = merkle.Subtree._keep
    monkeypatch.setattr(merkle.Subtree, "_keep", lambda self, *a: (keep(self, *a), held.append((len(self.nodes), len(self.stack.stack)))))
    list(merkle.traverse([bytes([i % 256]) * 32 for i in range(1000)], 10, 3))
    assert max(x for x, _ in held) <= 14 and max(x for _, x in held) <= 10


@pytest.mark.parametrize("block", [1, 3, 12])
def test_manifest_against_plain_trees(spark, block):
    rng = random.Random(block)
    docs = [(i, rng.choice([None, "", "text", "Ünïcode " * 3, "long " * 30_000]), lang, rng.choice([None, "s", "ä"]), rng.choice([None, 5])) for lang, n in (("en", 23), (None, 3), ("", 1), ("é", 9), ("z", 2)) for i in range(n)]
    docs += [(None, "no id", "en", "s", 1), (None, "no id either", "en", "s", 1), (4, "again", "en", "s", 1), (4, "again", "en", "s", 1)]
    rng.shuffle(docs)
    table = spark.createDataFrame(docs, DOC).selectExpr("*", "doc_id AS key", "text AS digest", "lang AS pos", "lang AS root", "lang AS proof", "lang AS at")
    proved = merkle.prove(table, block=block)
    got = sorted(tuple(map(str, r)) for r in proved.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof"))).collect())
    assert got == plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), d)) for d in docs])
    assert proved.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_tampering_is_seen(spark):
    docs = docs_of(spark, [(i, f"text {i}") for i in range(40)])
    struck = F.col("doc_id") % 3 == 0
    proved = merkle.prove(docs, claimed=F.when(struck, merkle.leaf(text=F.concat("text", F.lit("!")))))
    bad = proved.where(merkle.fold(F.coalesce("claimed", "leaf"), F.col("proof")) != F.col("root"))
    assert {r["doc_id"] for r in bad.collect()} == set(range(0, 40, 3))
    assert merkle.prove(docs_of(spark, [])).count() == 0


def test_query_verifies_all_but_tampered_rows(spark):
    got = queries.op13_merkle(spark, SF).toPandas()
    struck = got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 7 == 0)
    assert (got.verified == ~struck).all() and struck.any()
