"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label.  A sentence's score is
logistic in the words that it holds (and in their beginnings, which carry inflected and
compound forms); the document's is the noisy-or of its sentences and of a leak that stands
for labels that no sentence explains.  The weights are learned from document labels alone;
afterwards the sentence scores say which sentences offend.
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

from quillspark.llm.common import limit_batches

#: Labelled documents of each class that the model is fitted on, and the longest text among them.
SAMPLE_DOCS, SAMPLE_CHARS = 4000, 60_000
#: Fewest toxic documents with a feature, and how many times as frequent it must be in them.
LEAST_DOCS, LEAST_LIFT = 4, 3.0
PREFIXES = (4, 5, 6, 7, 8)
EPOCHS, RATE, L1, L2 = 250, 0.08, 2e-5, 1e-4
CACHE_WORDS = 250_000
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word and its proper beginnings."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class NoisyOr:
    weights: dict[str, float]
    bias: float
    leak: float

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


def fit(bags: list[str], labels: np.ndarray, importance: np.ndarray) -> NoisyOr:
    """Learn from whole texts, their labels and the rows that each stands for."""
    if not len(bags) or labels.min() == labels.max():
        rate = float(np.average(labels, weights=importance)) if len(bags) else 0.0
        return NoisyOr({}, -40.0, min(max(rate, 0.0), 1.0))
    texts = [t.lower() for t in bags]
    df: list[Counter] = [Counter(), Counter()]
    total = [0.0, 0.0]
    for t, y, m in zip(texts, labels, importance):
        total[y] += m
        for f in {f for w in set(_WORD.findall(t)) for f in features(w)}:
            df[y][f] += m
    least = LEAST_DOCS * importance[labels == 1].min()
    names = sorted(f for f, n in df[1].items() if n >= least and n / total[1] > LEAST_LIFT * (df[0][f] / total[0]))
    place = {f: i for i, f in enumerate(names)}
    known: dict[str, list[int]] = {}
    sentence_of, feature_of, bag_of = [], [], []
    plain = np.zeros(len(texts))
    for bag, t in enumerate(texts):
        for s in _SENTENCE.findall(t):
            hit: set[int] = set()
            for w in set(_WORD.findall(s)):
                if w not in known:
                    known[w] = [place[f] for f in features(w) if f in place]
                hit.update(known[w])
            if hit:
                sentence_of += [len(bag_of)] * len(hit)
                feature_of += hit
                bag_of.append(bag)
            else:
                plain[bag] += 1
    so, fo, bo = np.array(sentence_of, np.int64), np.array(feature_of, np.int64), np.array(bag_of, np.int64)
    weight = importance / importance.sum()
    theta = np.zeros(len(names) + 2)  # weights, bias, leak's log odds
    theta[-2], theta[-1] = -6.0, -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    y = labels.astype(float)
    for step in range(1, EPOCHS + 1):
        z = theta[-2] + np.bincount(so, theta[fo], len(bo))
        p, p0, leak = _sigmoid(z), _sigmoid(theta[-2]), _sigmoid(theta[-1])
        log_no = np.bincount(bo, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)) + plain * np.log1p(-p0) + np.log1p(-leak)
        no = np.exp(log_no)
        yes = np.maximum(1 - no, 1e-9)
        # derivative of the weighted log likelihood by log(no): labels 1 pull it down, 0 up
        d = weight * np.where(y == 1, -no / yes, 1.0)
        gz = -p * d[bo]  # d log(no) / dz = -p
        grad = np.zeros_like(theta)
        grad[:-2] = np.bincount(fo, gz[so], len(names)) - L2 * theta[:-2]
        grad[-2] = gz.sum() - (plain * p0 * d).sum()
        grad[-1] = -(leak * d).sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        theta[:-2] = np.sign(theta[:-2]) * np.maximum(np.abs(theta[:-2]) - RATE * L1 * 100, 0)
    return NoisyOr({f: float(w) for f, w in zip(names, theta) if w}, float(theta[-2]), float(_sigmoid(theta[-1])))


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> NoisyOr:
    """Fit on labelled rows (``doc_id, toxic`` of ``labels``).

    At most ``sample_docs`` documents of each class, of at most ``sample_chars`` characters, are
    chosen by a hash of their id and weighted back to the classes' sizes.  An id with several
    labels is toxic where any is 1; of several texts of one id the least is taken; labels
    without a document count for nothing.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").hint("merge"), "doc_id", "left_semi")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return NoisyOr({}, -40.0, 0.0)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 32)) / float(1 << 32)
    share = F.create_map(*(F.lit(x) for label, n in sizes.items() for x in (label, 1.2 * sample_docs / n)))
    chosen = known.where(draw < share[F.col("toxic")])
    rows = docs.where(F.length("text").between(1, sample_chars)).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # the draw bounds its rows
    picked = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", draw.alias("draw")).collect()
    picked = sorted(picked, key=lambda r: (r["draw"], r["text"]))
    texts, ys = [], []
    count: Counter = Counter()
    for text, y, _ in picked:
        if count[y] < sample_docs:
            count[y] += 1
            texts.append(text), ys.append(int(y))
    y = np.array(ys, np.int64)
    return fit(texts, y, np.array([sizes[k] / count[k] for k in ys], float))


class Scorer:
    """Scores texts with a bounded cache of words."""

    def __init__(self, model: NoisyOr, most: int = CACHE_WORDS):
        self.model, self.most, self.known = model, most, {}
        self.plain = float(np.log1p(-_sigmoid(np.array(model.bias))))

    def piece(self, piece: str) -> tuple[str, ...]:
        """Words of a piece without white space that have any weight."""
        words = tuple(w for w in _WORD.findall(piece) if self.model.word(w))
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[piece] = words
        return words

    def text(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (start, end, score) of each sentence above 0.5."""
        log_no, found = float(np.log1p(-min(self.model.leak, 1 - 1e-12))), []
        lowered = (text or "").lower()
        same = len(lowered) == len(text or "")
        known, weigh = self.known, self.model.word
        for m in _SENTENCE.finditer(lowered):
            words: set[str] = set()
            for p in m.group().split():
                hit = known.get(p)
                if hit is None:
                    hit = self.piece(p)
                if hit:
                    words.update(hit)
            if not words:
                log_no += self.plain
                continue
            z = min(40.0, self.model.bias + sum(weigh(w) for w in sorted(words)))
            log_no -= np.log1p(np.exp(z))
            if z > 0 and same:
                found.append((m.start(), m.end(), float(1 / (1 + np.exp(-z)))))
        return float(-np.expm1(log_no)), found


def assess(model: NoisyOr, docs: DataFrame) -> Column:
    """Column of ``text`` (of ``docs``) giving struct<score, offending: array<struct<start, end, score>>>.

    ``score`` is the chance of the toxic label, in 0 to 1; NULL and empty texts have the
    leak alone.  ``offending`` lists sentences above one half by code point offsets (none
    where lower-casing changes the text's length).
    """
    limit_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for array in arrays:
            scores, offending = [], []
            for text in array:
                score, found = scorer.text(text.as_py())
                scores.append(score)
                offending.append([{"start": a, "end": b, "score": s} for a, b, s in found])
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(offending, spans)], ["score", "offending"])

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<score:double,offending:array<struct<start:int,end:int,score:double>>>")(F.col("text"))


def score(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """``doc_id, score, offending`` of every row (see ``assess``).

    Repeated rows each give a row, an empty table gives none; other columns are ignored.
    """
    return docs.select("doc_id", assess(model, docs).alias("found")).select("doc_id", "found.*")
