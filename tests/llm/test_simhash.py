import random

import pandas as pd
import xxhash

from quillspark.llm import components, queries, simhash
from tests.conftest import SF
from tests.llm.helpers import docs_of


def plain_fingerprint(text, k):
    words = [w.encode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_query_against_brute_force(spark):
    texts = pd.read_parquet(f"{SF}/documents.parquet")
    fps = {i: plain_fingerprint(t, 3) for i, t in zip(texts.doc_id, texts.text)}
    ids = sorted(fps)
    want = union([(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], ids)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash(spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


def test_links_are_all_found(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    points = set(base)
    for b in base:
        for _ in range(15):
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                b ^= 1 << bit
            points.add(b)
    points |= {0, (1 << 64) - 1, 1, 7, 15}
    want = {(a, b) for a in points for b in points if a != b and (a ^ b).bit_count() <= 3}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(signed(p),) for p in points], "fp bigint")).collect()}
    assert got == {(signed(a), signed(b)) for a, b in want if signed(a) < signed(b)}


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(4, None), (2, ""), (9, " \n"), (5, "One two"), (5, "one TWO"), (3, "one\x0btwo"), (8, "ÉCOLE une deux trois"), (7, "école une deux trois"), (None, "alone here"), (None, "x y z w v")]
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.near_duplicates(docs_of(spark, rows), 3).collect())
    assert got == sorted([("4", 2), ("2", 2), ("9", 2), ("5", 3), ("5", 3), ("3", 3), ("8", 8), ("7", 7), ("None", None), ("None", None)])
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_components_of_long_paths(spark):
    rng = random.Random(1)
    nodes = rng.sample(range(10**6), 400)
    pairs = list(zip(nodes[:150], nodes[1:150])) + [(nodes[200], x) for x in nodes[201:260]] + [(nodes[300], nodes[300]), (nodes[300], nodes[301])] * 2
    want = union(pairs, {x for p in pairs for x in p})
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
