import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from quillspark.llm import context_tree as ct
from quillspark.llm import queries
from tests.conftest import SF
from tests.llm.helpers import docs_of


def coded(text):
    """(context nearest first, symbol) of every coded byte, the plain way."""
    tokens = (text or "").encode().lower().split()
    out, before = [], b"\n"
    for token in [*tokens, None]:
        spelled = b"\n" if token is None else token + b" "
        for j, symbol in enumerate(spelled):
            context = spelled[:j][::-1] + b" " + (before[-ct.TAIL :][::-1] if j < ct.HEAD else b"")
            out.append(((context + b"\0" * ct.DEPTH)[: ct.DEPTH], symbol))
        before = token
    return out


class PlainTree:
    """Context-tree weighting with one node object for each context and decision."""

    def __init__(self, pairs):
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for context, symbol in pairs:
            for t in range(8):
                prefix, bit = 1 << t | symbol >> (8 - t), symbol >> (7 - t) & 1
                for d in range(ct.DEPTH + 1):
                    self.counts[context[:d], prefix][bit] += 1
                    if d:
                        self.children[context[: d - 1], prefix].add(context[:d])
        self.weighted = {}
        for context, prefix in sorted(self.counts, key=lambda k: -len(k[0])):
            e = self.kt(*self.counts[context, prefix])
            if len(context) < ct.DEPTH:
                below = sum(self.weighted[c, prefix] for c in self.children[context, prefix])
                self.weighted[context, prefix] = np.logaddexp(e, below) - math.log(2)
            else:
                self.weighted[context, prefix] = e

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log10(self, context, symbol):
        total = 0.0
        for t in range(8):
            prefix, bit = 1 << t | symbol >> (8 - t), symbol >> (7 - t) & 1
            p = None
            for d in range(ct.DEPTH, -1, -1):
                n = self.counts.get((context[:d], prefix), (0, 0))
                here = (n[bit] + 0.5) / (sum(n) + 1)
                if p is None:
                    p = here
                else:
                    w = math.exp(self.kt(*n) - math.log(2) - self.weighted.get((context[:d], prefix), 0.0))
                    p = w * here + (1 - w) * p
            total += math.log10(p)
        return total


ROWS = [(i, t) for i, t in enumerate(["the cat sat on the mat", "The dog sat\ton  the log", None, "", "é è ünï the CAT", "a\x85b\xa0c", "cat cat cat the then there these", " \n ", "x" * 300 + " the mat", "one two"])]


def in_training(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


def check(got, rows):
    training = [t for i, t in rows if in_training(i)]
    tokens = Counter(w for t in training for w in [*(t or "").encode().lower().split(), b" "])
    n, v = sum(tokens.values()), len(tokens)
    tree = PlainTree([p for t in training for p in coded(t)])
    want = []
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), b" "]
        base = sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want.append((str(i), not in_training(i), len(words), sum(tokens[w] > 0 for w in words), n, round(base, 6), round(sum(tree.log10(*p) for p in coded(t)), 6), len(coded(t))))
    assert sorted((str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6), r[7]) for r in got) == sorted(want)


def test_against_plain_tree(spark):
    rows = [*ROWS, (3, "again the cat"), (3, "again the cat"), (None, "the null"), (None, None)]
    check(ct.score_documents(docs_of(spark, rows)).collect(), rows)


def test_small_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK_BYTES", 30)
    monkeypatch.setattr(ct, "PART_UNITS", 7)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["the", "cat", "then", "these", "Ω", "a", "in"], k=rng.randint(0, 12)))) for i in range(40)]
    check(ct.score_documents(docs_of(spark, rows)).collect(), rows)


def test_empty_tables(spark):
    assert ct.score_documents(docs_of(spark, [])).count() == 0
    alone = [(i, "some words") for i in range(200) if not in_training(i)][:2]
    rows = ct.score_documents(docs_of(spark, alone)).collect()
    assert [(r["train_tokens"], r["n_known"], r["base_score"]) for r in rows] == [(0, 0, 0.0)] * 2
    assert rows[0]["score"] == pytest.approx(-8 * rows[0]["n_bytes"] * math.log10(2))


def test_decisions_of_a_context_add_up_to_one():
    rng = np.random.default_rng(1)
    contexts = rng.integers(0, 3, (30, ct.DEPTH))
    base = sum(contexts[:, k].astype(np.uint64) << np.uint64(8 * k + 8) for k in range(ct.DEPTH))
    windows = (base[:, None] | np.arange(256, dtype=np.uint64)[None, :]).ravel()
    counts = (rng.random(len(windows)) < 0.05) * rng.integers(1, 9, len(windows)).astype(float)
    windows, where = np.unique(windows, return_inverse=True)
    counts = np.bincount(where, counts)
    mixed, top = ct.deep_mix(windows, counts, ct.DEPTH, 3)
    key = np.concatenate([k for k, *_ in top])
    two, at = np.unique(key & np.uint64(0xFFFFFF), return_inverse=True)
    nodes = ct.TopNodes(two, *(np.bincount(at, np.concatenate([x[i] for x in top])) for i in (1, 2, 3)))
    p = np.exp(nodes.log_probability(windows, mixed))
    assert np.allclose(np.bincount(np.unique(windows >> np.uint64(8), return_inverse=True)[1], p), 1)


def test_query_columns_and_quality(spark):
    texts = dict(pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"]).itertuples(index=False))
    got = queries.op3_context_tree(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    tokens = Counter(w for i, t in texts.items() if in_training(i) for w in [*t.encode().lower().split(), b" "])
    n, v = sum(tokens.values()), len(tokens)
    for r in got:
        words = [*texts[r["doc_id"]].encode().lower().split(), b" "]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not in_training(r["doc_id"]), len(words), sum(tokens[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert r["score"] < 0
