import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import bpe, token_store
from tests.llm.helpers import docs_of

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SPEC = open(PATH, encoding="utf-8").read()
ROWS = [
    (3, "The thing's  over-\tthere, 12 times!\nNaïve Ünïcode — ß"),
    (1, None),
    (2, ""),
    (7, "a<|endoftext|>b <|startoftext|>x" + "y" * 3000),
    (7, "a<|endoftext|>b <|startoftext|>x" + "y" * 3000),
    (None, "no id"),
    (5, "ab" * 5000 + "́" + "=" * 700 + "１２３٤"),
    (9, "a\x1cb Don.t DON'T it's. <|ENDOFTEXT|>, 5. ..,. <|startoftext|>. \x85 　 x y"),
]


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def small_tree():
    return bpe.TreeEncoder(SPEC, leaf=6)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abenorst'éß1!=́<|>", max_size=120))
def test_tree_concatenation_equals_library(text):
    tree = test_tree_concatenation_equals_library.tree = getattr(test_tree_concatenation_equals_library, "tree", None) or bpe.TreeEncoder(SPEC, leaf=6)
    assert tree.long_piece(text) == expected(text)


def test_tree_on_long_runs(small_tree):
    rng = random.Random(5)
    vocabulary = [t.replace("</w>", "") for t in list(LIBRARY.get_vocab())[:4000] if t.replace("</w>", "").isascii() and t.replace("</w>", "").isalpha()]
    for n in (7, 50, 900):
        text = "".join(rng.choices(vocabulary, k=n)).lower()
        assert small_tree.long_piece(text) == expected(text)
    assert small_tree.long_piece("a" * 5000) == expected("a" * 5000)


def test_encode_documents_matches_library(spark):
    got = bpe.encode_documents(docs_of(spark, ROWS), PATH).collect()
    assert len(got) == len(ROWS)
    want = sorted((str(i), np.array(expected(t), "<u4").tobytes(), LIBRARY.decode(expected(t), skip_special_tokens=False)) for i, t in ROWS)
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), r["decoded"]) for r in got) == want


def test_bounded_cache_forgets(spark):
    coder = bpe.CachedEncoder(SPEC, most=3)
    for text in ("one two three four", "two five", "one one six"):
        ids = coder.encode([text])
        assert ids[0].tolist() == expected(text)
    assert len(coder.slots) <= 4


def test_random_access():
    rng = np.random.default_rng(1)
    ids = np.where(rng.random(5000) < 0.5, rng.integers(0, 200, 5000), rng.integers(0, 1 << 24, 5000)).astype(np.uint32)
    shard = token_store.TokenShard(token_store.pack(ids, np.array([0, 10, 10, 5000])))
    assert (shard.all() == ids).all()
    assert [shard.token(i) for i in range(5000)] == ids.tolist()
    assert shard.document(0).tolist() == ids[:10].tolist() and len(shard.document(1)) == 0
    with pytest.raises(IndexError):
        shard.token(5000)
    empty = token_store.TokenShard(token_store.pack(np.zeros(0, np.uint32), np.array([0, 0])))
    assert len(empty.all()) == 0


@pytest.mark.parametrize("shard_ids", [1, 40, 1 << 20])
def test_store_round_trip(spark, tmp_path, shard_ids):
    path = f"file://{tmp_path}/store"
    token_store.write_token_store(docs_of(spark, ROWS), path, PATH, 1, shard_ids)
    got = token_store.read_token_store(spark, path).collect()
    assert len(got) == len(ROWS)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == [None, 1, 2, 3, 5, 7, 7, 9]
    at = 0
    texts = {i: t for i, t in ROWS}
    for r in order:
        ids = [*expected(texts[r["doc_id"]]), 1]
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_runs_by_rank():
    rng = np.random.default_rng(5)
    ids = rng.choice([3, 255, 256, 70_000, 1 << 25, (1 << 32) - 1], 3000).astype(np.uint32)
    shard = token_store.TokenShard(token_store.pack(ids, np.array([0, 3000])))
    for a, b in [(0, 0), (0, 3000), (3000, 3000), (511, 513), (512, 1024), *np.sort(rng.integers(0, 3001, (50, 2)), axis=1).tolist()]:
        assert (shard.run(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        shard.run(0, 3001)


@pytest.mark.parametrize("shard_ids", [7, 1 << 20])
def test_lookup_by_global_position(spark, tmp_path, shard_ids):
    path = f"file://{tmp_path}/store"
    token_store.write_token_store(docs_of(spark, ROWS), path, PATH, 1, shard_ids)
    rows = sorted(token_store.read_token_store(spark, path).collect(), key=lambda r: r["start"])
    ids = np.frombuffer(b"".join(r["ids"] for r in rows), "<u4").tolist()
    asked = [*range(len(ids)), 0, 0, -1, len(ids), None, 1 << 40]
    got = token_store.lookup_tokens(spark, path, spark.createDataFrame([(i,) for i in asked], "position bigint")).collect()
    assert sorted((r["position"], r["token"]) for r in got) == list(enumerate(ids))


def test_store_of_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_token_store(docs_of(spark, []), path, PATH, 1)
    assert token_store.read_token_store(spark, path).count() == 0


def test_queries_against_library(spark):
    import pandas as pd

    from quillspark.llm import queries
    from tests.conftest import SF

    texts = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"]).sort_values("doc_id")
    one = {r["doc_id"]: r for r in queries.op1_token_store(spark, SF).collect()}
    seven = {r["doc_id"]: r for r in queries.op7_bpe(spark, SF).collect()}
    at = 0
    for i, t in texts.itertuples(index=False):
        ids = expected(t)
        data = np.array([*ids, 1], "<u4").tobytes()
        assert (one[i]["start"], one[i]["n_tokens"], one[i]["ids_crc32"]) == (at, len(ids) + 1, zlib.crc32(data))
        at += len(ids) + 1
        assert seven[i]["ids_sha256"] == hashlib.sha256(data[:-4]).hexdigest()
        assert seven[i]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert seven[i]["n_tokens"] == len(ids)
