"""Language identification with interpolated Kneser-Ney character models.

One model is learned per language from a bounded, documented sample of labelled rows.  All
languages share sorted arrays of 64-bit n-gram hashes; beside each hash stands the
interpolated log probability under every language, and beside each context hash the log
weight of backing off from it.  A word's n-grams depend on nothing outside the word, so
every distinct word is scored once and the result is kept in a bounded cache.  The
language of least cross-entropy a character wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import crc_bucket, limit_batches

ORDER = 5
#: Labelled documents of each language that the models are fitted on, and the longest text among them.
SAMPLE_DOCS, SAMPLE_CHARS = 500, 100_000
#: Deviations up to this one are accepted in every language.
LEAST_LIMIT = 35.0
#: Calibration texts that a language needs for a mean and a spread of its own.
LEAST_TEXTS = 20
CACHE_WORDS = 150_000
_RUN = re.compile(r"[^\W\d_]+")
#: Pieces that aren't language: numbers, keys, mail addresses.
_MARKED = re.compile(r"[\d@]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each character, of the words' own characters.

    Returns (keys, reach, word): keys[n - 1, i] is the n-gram ending at character i and
    reach[i] the largest n there (the boundary before a word counts as its first
    character); word[i] is the word's index.  A boundary follows each word as well.
    """
    joined = "\0" + "\0".join(words) + "\0" if words else ""
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.arange(len(chars))
    edge = chars == 0
    start = np.maximum.accumulate(np.where(edge, at, 0))
    start[1:] = np.where(edge[1:], start[:-1], start[1:])  # a boundary that ends a word belongs to it
    reach = np.minimum(at - start + 1, order)
    code = _mix(chars + _MIX)
    keys = np.zeros((order, len(chars)), np.uint64)
    if len(chars):
        keys[0] = code
        for n in range(1, order):
            keys[n, 1:] = _mix(keys[n - 1, :-1] * _MIX + code[1:] + np.uint64(n))
    word = np.cumsum(edge) - 1
    word[1:] = np.where(edge[1:], word[:-1], word[1:])
    return keys[:, 1:], reach[1:], word[1:]


@dataclass
class KneserNey:
    """Models of ``langs``; tables[n - 1] = (hashes, log probabilities), backoffs[n - 1] = (context hashes, log weights)."""

    langs: list[str]
    floor: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]
    backoffs: list[tuple[np.ndarray, np.ndarray]]
    #: For each language: mean cross-entropy, its variance beyond length, variance of one character, largest accepted deviation.
    limits: np.ndarray | None = None

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word under each language, and its number of characters with the boundary."""
        keys, reach, word = ngram_hashes(words, len(self.tables))
        log = np.tile(self.floor, (len(reach), 1)).astype(np.float32)
        for n, (table, back) in enumerate(zip(self.tables, self.backoffs), 1):
            use = np.flatnonzero(reach >= n)
            slot, found = _find(table[0], keys[n - 1, use])
            log[use[found]] = table[1][slot[found]]
            rest = use[~found]
            context = keys[n - 2, rest - 1] if n > 1 else np.zeros(len(rest), np.uint64)
            if n > 1 and len(rest):
                first = rest == 0  # before the first character stands the boundary
                context[first] = _mix(np.zeros(1, np.uint64) + _MIX)[0]
            slot, found = _find(back[0], context)
            log[rest[found]] += back[1][slot[found]]
        total = np.zeros((len(words), len(self.langs)))
        np.add.at(total, word, log)
        return total, np.bincount(word, minlength=len(words))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    slot = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return slot, table[slot] == keys


def fit(samples: dict[str, list[str]], order: int = ORDER) -> KneserNey:
    """Models from whole texts of each language."""
    langs = sorted(samples)
    counts = [Counter(w for t in samples[lang] for w in _RUN.findall(t.lower())) for lang in langs]
    words = sorted(set().union(*counts)) if langs else []
    times = np.array([[c[w] for w in words] for c in counts], np.float64).reshape(len(langs), len(words))
    keys, reach, word = ngram_hashes(words, order)
    start_key = _mix(np.zeros(1, np.uint64) + _MIX)[0]
    alphabet = len(np.unique(keys[0])) + 1 if len(words) else 1
    floor = np.full(len(langs), -np.log(alphabet))
    tables, backoffs = [], []
    lower = np.tile(floor, (1, 1))
    for n in range(1, order + 1):
        use = np.flatnonzero(reach >= n)
        table, first, where = np.unique(keys[n - 1, use], return_index=True, return_inverse=True)
        at = use[first]
        count = np.zeros((len(langs), len(table)))
        if n < order:  # kinds of characters before the n-gram, or plain counts where nothing can stand before it
            open_end = np.flatnonzero(reach[use] > n)
            longer, rep = np.unique(keys[n, use[open_end]], return_index=True)
            seen = np.searchsorted(longer, keys[n, use[open_end]])
            closed = np.flatnonzero(reach[use] == n)
            for i in range(len(langs)):
                kinds = np.bincount(seen, times[i, word[use[open_end]]], len(longer)) > 0
                count[i] = np.bincount(where[open_end[rep]], kinds, len(table)) + np.bincount(where[closed], times[i, word[use[closed]]], len(table))
        else:
            for i in range(len(langs)):
                count[i] = np.bincount(where, times[i, word[use]], len(table))
        context = np.where(at > 0, keys[n - 2, at - 1], start_key) if n > 1 else np.zeros(len(at), np.uint64)
        contexts, of = np.unique(context, return_inverse=True)
        if n > 1:
            slot, _ = _find(tables[-1][0], keys[n - 2, at])
            lower = tables[-1][1][slot]
        else:
            lower = np.tile(floor, (len(table), 1))
        prob, weight = np.zeros((len(table), len(langs))), np.zeros((len(contexts), len(langs)))
        for i in range(len(langs)):
            c = count[i]
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
            total = np.bincount(of, c, len(contexts))
            kinds = np.bincount(of, c > 0, len(contexts))
            spare = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            seen_part = np.where(total[of] > 0, np.maximum(c - discount, 0) / np.maximum(total[of], 1), 0.0)
            prob[:, i] = np.log(seen_part + spare[of] * np.exp(lower[:, i]))
            weight[:, i] = np.log(spare)
        tables.append((table, prob.astype(np.float32)))
        backoffs.append((contexts, weight.astype(np.float32)))
    return KneserNey(langs, floor, tables, backoffs)


class Scorer:
    """Scores texts with a bounded cache of words."""

    def __init__(self, model: KneserNey, most: int = CACHE_WORDS):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.log = np.zeros((0, len(self.model.langs)))
        self.size = np.zeros(0, np.int64)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of each text under each language, and its characters with boundaries."""
        if not self.model.langs:
            return np.zeros((len(texts), 0)), np.zeros(len(texts), np.int64)
        split = [t.lower().split() if t else [] for t in texts]
        new = set().union(*split) if split else set()
        if len(self.slot) + len(new) > self.most:
            self.clear()
        new = [p for p in new if p not in self.slot]
        if new:
            runs = [_RUN.findall(p) if p.isalpha() or not _MARKED.search(p) else [] for p in new]
            flat = list({r for rs in runs for r in rs})
            place = {r: i for i, r in enumerate(flat)}
            log, size = self.model.score(flat)
            log, size = np.vstack([log, np.zeros((1, log.shape[1]))]), np.append(size, 0)
            one = np.array([place[r[0]] if len(r) == 1 else len(flat) for r in runs])
            logs, sizes = log[one], size[one]
            for i, r in enumerate(runs):
                if len(r) > 1:
                    at = [place[x] for x in r]
                    logs[i], sizes[i] = log[at].sum(0), size[at].sum()
            for p in new:
                self.slot[p] = len(self.slot)
            self.log, self.size = np.vstack([self.log, logs]), np.append(self.size, sizes)
        total, chars = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts), np.int64)
        for i, pieces in enumerate(split):
            if pieces:
                at = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
                total[i], chars[i] = self.log[at].sum(0), self.size[at].sum()
        return total, chars


def calibrate(model: KneserNey, texts: dict[str, list[str]]) -> np.ndarray:
    """Limits of rejection from texts that the model wasn't fitted on.

    The deviation of a text is how far its cross-entropy lies above the language's mean,
    in standard deviations for its length.  Up to three times the 99 % quantile of the
    calibration texts that the model gives to their own language, and ``LEAST_LIMIT`` at least,
    is accepted: a text under another language's label doesn't widen the limit.
    A language of fewer than ``LEAST_TEXTS`` such texts takes the figures of all languages together; with
    fewer than five in all, nothing is rejected.
    """
    scorer, own = Scorer(model), []
    for i, lang in enumerate(model.langs):
        total, chars = scorer.texts(texts[lang])
        use = (chars > 0) & (total.argmax(1) == i)
        own.append((-total[use, i] / np.maximum(chars[use], 1), chars[use]))
    pooled = [np.concatenate(x) for x in zip(*own)]
    out = []
    for entropy, n in own:
        if len(n) < LEAST_TEXTS:
            entropy, n = pooled
        if len(n) < 5:
            out.append((0.0, 1.0, 1.0, np.inf))
            continue
        mean = np.average(entropy, weights=np.minimum(n, 2000))
        one = np.median((entropy - mean) ** 2 * n) / 0.455
        long = n >= np.median(n)
        beyond = max(1e-4, np.median((entropy[long] - mean) ** 2) / 0.455 - np.mean(one / n[long]))
        deviation = (entropy - mean) / np.sqrt(beyond + one / n)
        out.append((mean, beyond, one, max(LEAST_LIMIT, 3.0 * float(np.quantile(deviation, 0.99)))))
    return np.array(out).reshape(-1, 4)


def learn(docs: DataFrame, modulus: int = 3, held_out: int = 1, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> KneserNey:
    """Fit and calibrate on rows with a language and a text whose crc32 bucket isn't ``held_out``.

    At most ``sample_docs`` distinct texts a language, of at most ``sample_chars`` characters,
    are chosen by a hash of the text, however often each is repeated.  Half of them calibrate
    the rejection of a model of the other half; the returned model is fitted on all.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket(F.col("doc_id"), modulus) != held_out) & (F.length("text") <= sample_chars)).select("lang", "text")
    code = F.xxhash64(F.lit("sample"), "text")
    sizes = {r["lang"]: r["n"] for r in rows.select("lang", code.alias("code")).distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return KneserNey([], np.zeros(0), [], [], np.zeros((0, 4)))
    draw = F.pmod(code, F.lit(1 << 32)) / float(1 << 32)
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, 1.5 * sample_docs / n)))
    drawn = rows.where(draw < share[F.col("lang")]).select("lang", "text", draw.alias("draw"))
    picked = drawn.groupBy("lang", "draw").agg(F.min("text").alias("text")).select("lang", "text", "draw").collect()
    by_lang: dict[str, list[str]] = {lang: [] for lang in sizes}
    for lang, text, _ in sorted(picked, key=lambda r: (r["lang"], r["draw"], r["text"])):
        if len(by_lang[lang]) < sample_docs:
            by_lang[lang].append(text)
    by_lang = {k: v for k, v in by_lang.items() if v}
    half = fit({k: v[::2] for k, v in by_lang.items()})
    model = fit(by_lang)
    model.limits = calibrate(half, {k: v[1::2] for k, v in by_lang.items()})
    return model


def identify(model: KneserNey, docs: DataFrame) -> Column:
    """Column of ``text`` (of ``docs``) giving struct<lang_pred, score, cross_entropy, rejected>.

    ``lang_pred`` is the language of least cross-entropy, ``und`` where the text is NULL or
    has no letter or nothing was learned; ties go to the first in alphabetical order.
    ``score`` is its posterior among the languages (0 for ``und``); ``rejected`` marks
    ``und`` and texts whose cross-entropy lies beyond the calibrated limit of the language.
    """
    limit_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<lang_pred:string,score:double,cross_entropy:double,rejected:boolean>"

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        langs, limits = scorer.model.langs, scorer.model.limits
        for array in arrays:
            preds, scores, entropies, rejects = [], [], [], []
            for at in range(0, len(array), 500):
                texts = array.slice(at, 500).to_pylist()
                total, chars = scorer.texts(texts)
                for t, n, text in zip(total, chars, texts):
                    if not langs or not text or not any(map(str.isalpha, text)):
                        preds.append("und"), scores.append(0.0), entropies.append(None), rejects.append(True)
                        continue
                    best = int(t.argmax())
                    n = max(n, 1)  # letters beside digits only: nothing to score
                    mean, beyond, one, most = limits[best]
                    preds.append(langs[best])
                    scores.append(float(1 / np.exp(t - t[best]).sum()))
                    entropies.append(float(-t[best] / n))
                    rejects.append(bool((-t[best] / n - mean) / np.sqrt(beyond + one / n) > most))
            yield pa.StructArray.from_arrays([pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(entropies, pa.float64()), pa.array(rejects, pa.bool_())], ["lang_pred", "score", "cross_entropy", "rejected"])

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(F.col("text"))


def predict(docs: DataFrame, model: KneserNey) -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected`` of every row (see ``identify``).

    Repeated rows each give a row, an empty table gives none; other columns are ignored.
    """
    return docs.select("doc_id", identify(model, docs).alias("found")).select("doc_id", "found.*")
