import random

import numpy as np
import pandas as pd

import corpus_pipeline
from quillspark.llm import simhash, similar
from tests.conftest import SF
from tests.llm.helpers import docs_of
from tests.llm.test_simhash import union


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def edited(text, changes, seed):
    rng = random.Random(seed)
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**9)}"
    return " ".join(words)


def test_cell_trees_join_what_all_pairs_join(monkeypatch):
    rng = np.random.default_rng(2)
    for block in (512, 7):
        monkeypatch.setattr(similar, "BLOCK", block)
        cell = np.sort(rng.integers(0, 6, 200))
        fps = rng.integers(0, 1 << 63, (12, similar.LANES), dtype=np.int64).astype(np.uint64)[rng.integers(0, 12, 200)]
        for _ in range(30):
            fps[np.arange(200), rng.integers(0, similar.LANES, 200)] ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
        close = [(i, j) for i in range(200) for j in range(i + 1, 200) if cell[i] == cell[j] and np.bitwise_count(fps[i] ^ fps[j]).sum() <= similar.MAX_BITS]
        i, j = similar.cell_trees(cell, fps)
        assert close and len(i) < 200
        assert union(zip(i.tolist(), j.tolist()), range(200)) == union(close, range(200))


def test_similar_groups_against_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for g in range(25):
        base = " ".join(f"g{g}w{rng.randint(0, 10**6)}" for _ in range(rng.randint(60, 300)))
        rows.append(base)
        rows += [edited(base, rng.choice([0, 1, 1, 2, 30]), (g, n).__hash__()) for n in range(rng.randint(0, 4))]
    rows += [None, "", " \n", "one two", "One  two", "one three"]
    sets = [shingles(t) for t in rows]
    alike = lambda a, b: a == b or bool(a) and len(a & b) >= 0.8 * len(a | b)
    want = union([(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if alike(sets[i], sets[j])], range(len(rows)))
    got = similar.similar_groups(docs_of(spark, list(enumerate(rows))).withColumnRenamed("doc_id", "ord")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["component"], []).append(r["ord"])
    assert sorted(map(sorted, groups.values())) == sorted([i for i in want if want[i] == k] for k in set(want.values()))


def test_pairs_inside_a_template_family_are_found(spark):
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = [f"g{g}w{n}" for n in range(400)]

        def changed(words, at, tag):
            return [f"{tag}x{n}" if n in at else w for n, w in enumerate(words)]

        for n in range(16):  # a little below 0.8 alike in shingles
            at = rng.sample(range(5, 395), 9)
            rows.append(" ".join(changed(base, at[:5], f"g{g}n{n}")))
            if n < 5:  # and a partner a little above it
                rows.append(" ".join(changed(changed(base, at[:1], f"g{g}n{n}"), at[5:], f"g{g}m{n}")))
    sets = [shingles(t) for t in rows]
    hashes = [similar.shingle_hashes(t, 5) for t in rows]
    fps = [np.unpackbits(np.frombuffer(similar.wide_fingerprint(h), np.uint8), bitorder="little") for h in hashes]
    samples = similar.sampling(len(rows))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (fps[i] != fps[j]).sum() <= similar.MAX_BITS and (fps[i] == fps[j])[samples].all(1).any()]
    alike = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert alike and len(pairs) > 3 * len(alike)
    want = union(alike, range(len(rows)))
    got = similar.similar_groups(docs_of(spark, list(enumerate(rows))).withColumnRenamed("doc_id", "ord")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["component"], []).append(r["ord"])
    assert sorted(map(sorted, groups.values())) == sorted([i for i in want if want[i] == k] for k in set(want.values()))


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base), (3, base + " end"), (9, edited(base, 1, 1)), (7, "quite other words here today"), (7, "quite other words here today"), (None, base), (None, "alone with no id at all"), (11, None), (12, "")]
    kept = similar.keep_one_of_each(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["11", "3", "7", "None"]
    assert similar.keep_one_of_each(docs_of(spark, [])).count() == 0


def test_near_duplicates_of_the_pipeline_are_linked_by_fingerprint_or_similarity(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    # one of many tries: 3 bits or fewer apart, though fewer than 0.8 of the 5-word shingles agree
    for seed in range(5000):
        base = " ".join(rng.choices(words, k=45))
        other = edited(base, 2, seed)
        a, b = shingles(base), shingles(other)
        if len(a & b) < 0.8 * len(a | b) and bin(simhash.fingerprint(base, 3) ^ simhash.fingerprint(other, 3)).count("1") <= 3:
            break
    else:
        raise AssertionError("no such pair")
    long = " ".join(f"l{i}" for i in range(300))
    chain = edited(long, 6, 3)  # similar to the text, and linked to it by similarity alone
    assert bin(simhash.fingerprint(long, 3) ^ simhash.fingerprint(chain, 3)).count("1") > 3
    rows = [(1, base), (2, other), (3, long), (4, chain), (5, "a text of its own with seven words"), (6, long + " ")]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, rows), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5]


def test_stages_keep_the_columns_and_only_remove(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        if name != "encoding":
            assert out.columns == docs.columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            for i, t in after.items():
                assert t == before[i] or name == "line_dedup" and set(t.split("\n")) <= set(before[i].split("\n"))
            before, docs = after, out
    texts = pd.read_parquet(f"{SF}/benchmark.parquet").text
    assert not any(b in t for b in texts for t in before.values())
    sets = {i: shingles(t) for i, t in before.items()}
    assert not [(i, j) for i in sets for j in sets if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j])]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == set(before)


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
