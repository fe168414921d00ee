import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quillspark.llm import queries, token_alignment
from tests.conftest import SF
from tests.llm.helpers import docs_of

PATHS = token_alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(PATHS.byte_level), SentencePieceProcessor(model_file=PATHS.pieces)
    a.encode_special_tokens = True
    return a, b


def plain_groups(libraries, text):
    """Groups of a whole text by the libraries alone: [(A ids, B ids)]; None where bytes differ."""
    a, b = libraries
    if not text:
        return None
    # GPT-2's published byte alphabet
    codes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {chr(c): c for c in codes} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in codes)}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    want = (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    out, i, j = [], 0, 0
    place_a, place_b = ({end: k for k, end in enumerate(ends, 1)} for ends in (ends_a, ends_b))
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = place_a[end], place_b[end]
        out.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    return out


def plain_rows(libraries, docs):
    groups = {i: plain_groups(libraries, t) for i, t in docs}
    counts = Counter((x[-1], y[-1]) for g in groups.values() for x, y in g or [])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    out = {}
    for i, g in groups.items():
        found = [counts[x[-1], y[-1]] for x, y in g or []]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        out[i] = (sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), len(g or []), sum(n == best[y[-1]] for n, (_, y) in zip(found, g or [])), sum(found), sha256(text.encode()).hexdigest() if text else "")
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_against_the_libraries(spark, libraries):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_token_alignment(spark, SF).collect()}
    assert got == plain_rows(libraries, list(zip(docs.doc_id, docs.text)))


def odd_texts():
    rng = random.Random(2)
    alphabet = ["a", "The", "é", " ", "  ", "\n", "\t", "\x1f", " ", " ", "🙂", "é", "’s", "'ll", "123", "<|endoftext|>", "<s>", "<0x41>", "</s>", "<unk>", ".", "...", "日本", "ﬁ", "\u0000", " ", "straße"]
    return ["".join(rng.choices(alphabet, k=rng.randint(1, 25))) for _ in range(400)] + [" ", "  ", "a ", " a", "a  ", "\n ", " \n", "x▁y", "▁", "z" * 30_000, "ab" * 20_000 + " c", " " * 5_000, "word " * 20_000]


def test_odd_texts_against_the_libraries(spark, libraries):
    texts = list(enumerate(odd_texts()))
    aligner = token_alignment.Aligner(PATHS)
    for (_, text), found in zip(texts, aligner.align([t for _, t in texts])):
        want = plain_groups(libraries, text)
        if want is None:
            assert found is None, text[:50]
        else:
            assert found[2].decode() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want), text[:50]
            assert found[:2] == (sum(len(x) for x, _ in want), sum(len(y) for _, y in want))


def test_cache_forgets(monkeypatch, libraries):
    monkeypatch.setattr(token_alignment, "CACHE_BYTES", 3000)
    aligner = token_alignment.Aligner(PATHS)
    for k in range(50):
        text = f"some words number {k} and_a_longer_word_{k}"
        (found,) = aligner.align([text])
        assert found[2].decode() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain_groups(libraries, text))
        assert aligner.kept < 5000 and len(aligner.slots) == len(aligner.bad) < 20


def test_counts_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "COUNTED_KEYS", 50)
    monkeypatch.setattr(token_alignment, "LOOKUP_LINKS", 64)
    rng = random.Random(4)
    rows = [(i, "x", [(rng.randint(1, 9) << 32) | rng.randint(0, 30) for _ in range(rng.choice([0, 1, 7, 300]))]) for i in range(60)]
    table = spark.createDataFrame([(i, t, bytearray(np.array(k, "<i8").tobytes())) for i, t, k in rows] + [(60, None, None)], "doc_id bigint, keys string, links binary").repartition(7)
    counts = Counter(k for _, _, keys in rows for k in keys)
    best = {}
    for k, n in counts.items():
        best[k >> 32] = max(n, best.get(k >> 32, 0))
    got = {r["doc_id"]: (r["keys"], r["n_links"], r["n_best"], r["count_sum"]) for r in token_alignment.weigh_links(table).collect()}
    assert got == {i: (t, len(k), sum(counts[x] == best[x >> 32] for x in k), sum(counts[x] for x in k)) for i, t, k in rows} | {60: (None, 0, 0, 0)}
    found = token_alignment.count_pairs(table)
    keys = np.array(sorted(counts), np.int64)
    assert len(found.shards) > 1 and found.lookup(keys).tolist() == [counts[k] for k in keys.tolist()]
    assert found.lookup(np.array([-1, 5, 1 << 50])).tolist() == [0, 0, 0]


def test_nulls_repeated_rows_and_no_rows(spark):
    docs = docs_of(spark, [(1, None), (2, ""), (None, "one two"), (3, "one two"), (3, "one two")]).selectExpr("*", "text AS links", "text AS groups")
    got = token_alignment.weigh_links(token_alignment.align(docs, PATHS)).collect()
    assert sorted((str(r["doc_id"]), r["n_links"], r["count_sum"], r["groups"] != "") for r in got) == [("1", 0, 0, False), ("2", 0, 0, False), ("3", 2, 6, True), ("3", 2, 6, True), ("None", 2, 6, True)]
    assert token_alignment.weigh_links(token_alignment.align(docs_of(spark, []), PATHS)).count() == 0
