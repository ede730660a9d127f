"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence gets a probability from a
logistic model over its distinct words and word beginnings, a document one minus the
product of its sentences' complements (noisy-or).  Only documents have labels;
the gradient of the document's likelihood reaches the sentences, so that after
training the sentences with high probability are the offending ones.

The model is fitted on a bounded sample of labelled rows; scoring is one pass
over all whole texts without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")
BITS = 20
PREFIXES = (4, 5, 6, 7)
CACHE, ROWS = 150_000, 256
FLOOR = -22.0  # the largest log odds of a sentence without offending words: millions of them stay far below 0.5


def features(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    mask = (1 << BITS) - 1
    out = [zlib.crc32(word.encode()) & mask]
    out += [zlib.crc32(b"^" + word[:n].encode()) & mask for n in PREFIXES if len(word) > n]
    return out


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[int, float]

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))


def fit(bags: Iterable[tuple[int, list[list[str]]]], negative_weight: float = 1.0, rounds: int = 300, l1: float = 5e-5, rate: float = 0.8, least: int = 3) -> Model:
    """Proximal Adagrad on the noisy-or likelihood of bags (label, sentences of words).

    Weights are at least 0: no clean word makes up for an offending one.  Features of fewer than ``least`` bags are left out.  Without both labels the
    bias alone is fitted.

    Every sentence adds to a bag, so that the bias alone would make a bag of thousands toxic.  It is therefore lowered
    to ``FLOOR`` at the end, and the weights are scaled to the likelihood's maximum for it.
    """
    vocabulary: dict[str, int] = {}
    labels, ids, per_sentence, bag_of = [], [], [], []
    for k, (y, sentences_) in enumerate(bags):
        labels.append(float(y))
        for words in sentences_:
            own = [vocabulary.setdefault(w, len(vocabulary)) for w in set(words)]
            ids.append(np.array(own, np.int32))
            per_sentence.append(len(own))
            bag_of.append(k)
    labels = np.array(labels)
    weight = np.where(labels > 0, 1.0, negative_weight)
    rate_pos = (weight * labels).sum() / max(1e-9, weight.sum())
    if not 0 < rate_pos < 1:
        return Model(FLOOR if rate_pos == 0 else 12.0, {})
    n_bags, bag_of = len(labels), np.array(bag_of, np.int32)
    sentence, ids = np.repeat(np.arange(len(bag_of), dtype=np.int32), per_sentence), np.concatenate(ids)
    own = [features(w) for w in vocabulary]
    first = np.concatenate(([0], np.cumsum([len(f) for f in own])))
    feature = np.concatenate([np.array(f, np.int32) for f in own])
    word = np.repeat(np.arange(len(own), dtype=np.int32), np.diff(first))
    n_words = len(own)
    del own, vocabulary
    seen, edges = np.zeros(1 << BITS, np.int32), np.searchsorted(bag_of[sentence], np.arange(n_bags + 1))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        words = np.unique(ids[lo:hi])
        seen[np.unique(feature[C.ranges(first[words], first[words + 1])])] += 1
    used = np.flatnonzero(seen >= least)
    short = np.full(1 << BITS, -1, np.int32)
    short[used] = np.arange(len(used))
    keep = short[feature] >= 0
    feature, word = short[feature[keep]], word[keep]
    theta, square = np.zeros(len(used)), np.full(len(used), 1e-6)
    per_bag = np.bincount(bag_of, minlength=n_bags).mean()
    bias, bias_square = float(np.log(rate_pos / per_bag)) - 3, 1e-6

    def evidence() -> np.ndarray:
        """Of each sentence: the sum of its words' weights."""
        return np.bincount(sentence, np.bincount(word, theta[feature], minlength=n_words)[ids], minlength=len(bag_of))

    for _ in range(rounds):
        z = bias + evidence()
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(-np.bincount(bag_of, np.logaddexp(0, z), minlength=n_bags))
        slope = np.where(labels > 0, -none / np.maximum(1 - none, 1e-9), 1.0) * weight / weight.sum()
        g = slope[bag_of] * p
        grad = np.bincount(feature, np.bincount(ids, g[sentence], minlength=n_words)[word], minlength=len(used))
        square += grad**2
        step = rate / np.sqrt(square)
        theta = np.maximum(theta - step * (grad + l1), 0)
        bias_square += g.sum() ** 2
        bias -= rate * g.sum() / np.sqrt(bias_square)
    if bias > FLOOR:
        base = evidence()

        def loss(scale: float) -> float:
            total = np.bincount(bag_of, np.logaddexp(0, FLOOR + scale * base), minlength=n_bags)
            return float((weight * np.where(labels > 0, -np.log(-np.expm1(-np.maximum(total, 1e-12))), total)).sum())

        scales = np.linspace(1, 2 * FLOOR / min(bias, FLOOR / 8), 60)
        scale = min(scales, key=loss)
        theta, bias = theta * scale, FLOOR
    large = np.flatnonzero(np.abs(theta) > 1e-4)
    return Model(bias, {int(used[x]): float(theta[x]) for x in large})


def sentences(text: str | None) -> list[list[str]]:
    return [WORD.findall(s) for s in SENTENCE.split((text or "").lower())]


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, sample: int = 2500, room: int = 50_000_000) -> Model:
    """Fit on at most ``sample`` toxic and as many other labelled documents, of any length.

    Rows are taken in the order of a hash of their id, of each label until their
    texts hold half of ``room`` characters (one document at least).  A document
    with several labels counts as toxic if one says so; null labels and held-out
    ids are left out; of several texts with one id the largest teaches.  The texts
    of the sample, ``room`` characters and two documents at most, are collected and
    become bags on the driver.
    """
    marked = labels.where((C.fold("doc_id", modulus) != held_out) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r.toxic: r["n"] for r in marked.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    chosen = [marked.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (F.col("toxic") > 0, F.col("toxic") <= 0)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    earlier = Window.partitionBy(F.col("toxic") > 0).orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length(F.coalesce("text", F.lit("")))).over(earlier), F.lit(0)))  # of at most 2 * sample rows
    rows = rows.withColumn("all", F.count("*").over(Window.partitionBy(F.col("toxic") > 0))).where(F.col("before") < room // 2)
    rows = sorted(rows.select("doc_id", "toxic", "text", "all").collect(), key=lambda r: r.doc_id)
    n = [min(count.get(k, 0), sample) for k in (0, 1)]
    for k in (0, 1):  # what the bound on characters left out
        own = [r["all"] for r in rows if (r.toxic > 0) == k]
        n[k] = n[k] * len(own) / own[0] if own else n[k]
    ratio = (count.get(0, 0) / n[0]) / (count.get(1, 0) / n[1]) if all(n) else 1.0
    return fit(((int(r.toxic > 0), sentences(r.text)) for r in rows), ratio)


def rated(texts: list[str | None], model: Model, cache: dict[str, float]) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Of each text: its score, start and length of its worst sentence, and that one's score."""
    bounds, sums, worst, bias = [0], [], [], model.bias
    if len(cache) > CACHE:
        cache.clear()
    for text in texts:
        low = (text or "").lower()
        found = []
        for s in SENTENCE.split(low):
            total = bias
            for w in set(WORD.findall(s)):
                try:
                    total += cache[w]
                except KeyError:
                    cache[w] = x = model.word(w)
                    total += x
            found.append(total)
        sums += found
        bounds.append(len(sums))
        k, at = max(range(len(found)), key=found.__getitem__), 0
        for n, m in enumerate(SENTENCE.finditer(text or "")):  # as written: lower-casing may change the length
            if n == k:
                worst.append((at, m.start() - at))
                break
            at = m.end()
        else:
            worst.append((at, len(text or "") - at))
    z = np.array(sums)
    if not len(z):
        return z, worst, z
    none, top = np.add.reduceat(np.logaddexp(0, z), bounds[:-1]), np.maximum.reduceat(z, bounds[:-1])
    return -np.expm1(-none), worst, 1 / (1 + np.exp(-np.clip(top, -700, 700)))


def score(docs: DataFrame, model: Model, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """Score every whole text and locate its worst sentence (start, length and score, in characters).

    A null or empty text is one empty sentence.  Ids play no part in a score; a
    null id counts as empty text in the fold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            value, worst, top = rated(batch["text"].to_pylist(), model, cache)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([C.crc(x) % modulus == held_out for x in batch["doc_id"].to_pylist()], pa.bool_()),
                    pa.array(value, pa.float64()),
                    pa.array((value >= 0.5).astype(np.int32), pa.int32()),
                    pa.array([w[0] for w in worst], pa.int64()),
                    pa.array([w[1] for w in worst], pa.int64()),
                    pa.array(top, pa.float64()),
                ],
                names=["doc_id", "held_out", "score", "predicted", "worst_start", "worst_length", "worst_score"],
            )
        cache.clear()
        C.release()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, worst_start long, worst_length long, worst_score double")


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns, whatever their names.

    A null or empty text is one empty sentence.  Equal rows fare alike: all stay or
    all go.  Ids play no part, so rows without one are kept or left out by their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            yield batch.filter(pa.array(rated(batch["text"].to_pylist(), model, cache)[0] < threshold, pa.bool_()))
        cache.clear()
        C.release()

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, sample: int = 2500) -> DataFrame:
    """Learn from ``labels`` outside the held-out fold, then score all of ``docs``: one row for each of its rows.

    Repeated rows are scored each, alike.  Without labels of both kinds the bias
    alone is learned.  Columns other than doc_id and text play no part.
    """
    return score(docs, learn(docs, labels, modulus, held_out, sample), modulus, held_out)
