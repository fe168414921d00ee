import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from quillspark.llm import language, queries
from tests.conftest import SF
from tests.llm.helpers import DOC, docs_of

SAMPLES = {"aa": ["banana bandana anna", "bab anna nab", "ana ban"], "bb": ["kiwi kit tik", "wik kiwi it"]}


def plain_kn(words, order):
    """Interpolated Kneser-Ney probabilities by dictionaries: a function of (gram)."""
    grams = [Counter() for _ in range(order + 1)]
    for w, c in words.items():
        s = "\0" + w + "\0"
        for i in range(1, len(s)):
            for n in range(1, order + 1):
                if i - n + 1 >= 0:
                    grams[n][s[i - n + 1 : i + 1]] += c
    return grams


def plain_tables(samples, order):
    vocab = {}
    for lang, texts in samples.items():
        vocab[lang] = Counter(w for t in texts for w in language._RUN.findall(t.lower()))
    alphabet = len({c for v in vocab.values() for w in v for c in w} | {"\0"}) + 1
    out = {}
    for lang, v in vocab.items():
        grams = plain_kn(v, order)
        counts = [None] * (order + 1)
        for n in range(1, order + 1):
            if n == order:
                counts[n] = Counter(grams[n])
                continue
            c = Counter()
            for g in grams[n + 1]:
                c[g[1:]] += 1
            for g, k in grams[n].items():
                if g[0] == "\0" and n > 1:
                    c[g] += k
            counts[n] = c
        out[lang] = counts, alphabet
    return out


def plain_word(tables, lang, order, word):
    counts, alphabet = tables[lang]
    total, s = 0.0, "\0" + word + "\0"
    for i in range(1, len(s)):
        p = 1 / alphabet
        for n in range(1, order + 1):
            if i - n + 1 < 0:
                break
            g = s[i - n + 1 : i + 1]
            c = counts[n]
            ones, twos = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
            d = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
            followers = [x for k, x in c.items() if k[:-1] == g[:-1]]
            if sum(followers):
                p = max(c[g] - d, 0) / sum(followers) + d * len(followers) / sum(followers) * p
        total += math.log(p)
    return total


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_model_against_dictionaries(order):
    model = language.fit(SAMPLES, order)
    tables = plain_tables(SAMPLES, order)
    words = ["banana", "kiwi", "zzz", "ban", "anakit", "a"]
    got, sizes = model.score(words)
    assert sizes.tolist() == [len(w) + 1 for w in words]
    want = [[plain_word(tables, lang, order, w) for lang in model.langs] for w in words]
    assert np.allclose(got, want, atol=1e-4)


def test_word_cache_and_repeats():
    model = language.fit(SAMPLES)
    small, large = language.Scorer(model, most=2), language.Scorer(model)
    texts = ["Banana, kiwi-tik banana!", None, "", "123 kiwi", "anna ban ana wik it nab"]
    for _ in range(2):
        a, n = small.texts(texts)
        b, m = large.texts(texts)
        assert np.allclose(a, b) and (n == m).all()
    total, chars = model.score(["banana", "kiwi", "tik"])
    assert np.allclose(large.texts(texts[:1])[0][0], total[0] * 2 + total[1] + total[2])


def test_und_null_and_unlearned(spark):
    model = language.KneserNey([], np.zeros(0), [], [], np.zeros((0, 4)))
    rows = [(1, "word"), (2, None), (None, "12 !"), (1, "word")]
    got = language.predict(docs_of(spark, rows), model).collect()
    assert len(got) == 4 and all((r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True) for r in got)
    assert language.learn(docs_of(spark, []).where("false")).langs == []
    assert language.predict(docs_of(spark, []), model).count() == 0


def test_learn_ignores_held_out_and_null_labels(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(ids[0], None, "xx", "s", 0), (ids[1], "ohne", None, "s", 0), (held[0], "fremd", "zz", "s", 0)]
    rows += [(i, "der die das und", "de", "s", 0) for i in ids[2:40]] + [(i, "the and of with", "en", "s", 0) for i in ids[40:80]]
    model = language.learn(spark.createDataFrame(rows, DOC))
    assert model.langs == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs_of(spark, [(1, "Der und das"), (2, "THE with"), (3, "…")]), model).collect()}
    assert got == {1: "de", 2: "en", 3: "und"}


def test_query_on_held_out_rows(spark):
    truth = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    got = queries.op5_language(spark, SF).toPandas().set_index("doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.index]).all()
    assert got.score.between(0, 1).all() and len(got) == len(truth)
    held = got[got.held_out]
    assert (held.lang_pred == truth.lang[held.index]).mean() > 0.97
    assert not got.rejected.any()


def test_unlearned_language_and_noise_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 3
    rng = random.Random(1)
    noise = " ".join("".join(rng.choices("qxzjkwvbtp", k=rng.randint(3, 9))) for _ in range(80))
    got = {r["doc_id"]: r["rejected"] for r in language.predict(docs_of(spark, [(1, finnish), (2, noise)]), model).collect()}
    assert got == {1: True, 2: True}


def test_repeated_texts_are_drawn_once(spark):
    ids = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, "the and of with", "en", "s", 0) for i in ids[:4000]] + [(i, f"der die das und {i}", "de", "s", 0) for i in ids[4000:4020]]
    model = language.learn(spark.createDataFrame(rows, DOC))
    assert model.langs == ["de", "en"]
