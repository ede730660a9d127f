"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weighted character n-grams (relative frequency in the
lower-cased document times inverse document frequency), hashed to a fixed
table.  Weights come from follow-the-regularised-leader with an elastic net, one
softmax over all languages; a temperature fitted on documents kept out of that
training calibrates the probabilities.

The classifier is fitted on a bounded sample; document frequencies are counted
over all training documents.  Scoring adds up one table row per character
position, over whole texts, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LETTER = re.compile(r"[^\W\d_]")
BITS, CELLS, ORDERS, SCALE = 18, 1 << 24, (1, 2, 3), 30.0  # the table has at most CELLS weights for all languages
CHARS = 1 << 19
SLICES, SALTS = 64, 512  # in which the tasks' document frequencies are added up
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def has_letter(text: str) -> bool:
    """Whether a character is a letter; numerals such as a half or a Roman eight are none."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def bits_for(languages: int) -> int:
    """Buckets (as a power of two) such that the table of weights keeps its bound for any number of languages."""
    return max(6, min(BITS, (CELLS // max(1, languages)).bit_length() - 1))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(points: np.ndarray, order: int, bits: int = BITS) -> np.ndarray:
    """The bucket of the n-gram that starts at each position but the last few."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(n, order * 0x2545F491 & 0xFFFFFFFF, np.uint32)
    for j in range(order):
        h = (h ^ points[j : j + n]) * _FACTORS[j]
        h ^= h >> np.uint32(15)
    return (h * _FACTORS[4]) >> np.uint32(32 - bits)


def of_texts(points: list[np.ndarray], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the buckets of all texts one after another (2**bits where an n-gram crosses texts), and where each
    text starts."""
    ends, joined = np.cumsum([len(p) for p in points]), np.concatenate(points)
    for order in ORDERS:
        h = hashed(joined, order, bits)
        for j in range(1, order):
            at = ends[:-1] - j
            h[at[(at >= 0) & (at < len(h))]] = 1 << bits
        yield h, np.concatenate(([0], ends[:-1]))


def groups(texts: list[str], which: list[int]) -> Iterator[list[int]]:
    """These texts, some at a time, up to ``CHARS`` characters or one text."""
    own, n = [], 0
    for k in which:
        if own and n + len(texts[k]) > CHARS:
            yield own
            own, n = [], 0
        own.append(k)
        n += len(texts[k])
    if own:
        yield own


def frequencies(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A document's buckets and their relative frequencies."""
    points = code_points(text)
    all_ = np.concatenate([hashed(points, n, bits) for n in ORDERS])
    buckets, n = np.unique(all_, return_counts=True)
    return buckets, n / max(1, len(all_))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # [bucket, language]: weight times inverse document frequency
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], seen: tuple[int, np.ndarray] | None = None, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-3, every: int = 5) -> Model:
    """(text, language) rows, in training order; each ``every``-th one calibrates only.

    ``seen``: how many documents there are and in how many each bucket occurs; by default those of the rows.
    """
    languages = sorted({lang for _, lang in rows})
    k = len(languages)
    bits = bits_for(k)
    size = 1 << bits
    if k < 2:
        return Model(languages, np.zeros((size + 1, k)), np.zeros(k), 1.0)
    number = {lang: x for x, lang in enumerate(languages)}
    bags = [(frequencies(text, bits), number[lang]) for text, lang in rows]
    held = [b for x, b in enumerate(bags) if x % every == every - 1]
    bags = [b for x, b in enumerate(bags) if x % every != every - 1]
    if seen is None:
        df = np.zeros(size)
        for (buckets, _), _ in bags:
            df[buckets] += 1
        seen = len(bags), df
    idf = np.log((1 + seen[0]) / (1 + seen[1])) + 0.1
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))  # the last row is the bias

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) > l1, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for (buckets, tf), y in bags:
            at = np.append(buckets, size)
            x = np.append(tf * idf[buckets] * SCALE, 1.0)
            w = weights(at)
            g = _softmax(x @ w)
            g[y] -= 1
            grad = x[:, None] * g[None, :]
            step = (np.sqrt(n[at] + grad**2) - np.sqrt(n[at])) / alpha
            z[at] += grad - step * w
            n[at] += grad**2
    table = weights(np.arange(size + 1))
    bias = table[size].copy()
    table[:size] *= idf[:, None] * SCALE
    table[size] = 0
    logits = np.array([tf @ table[buckets] + bias for (buckets, tf), _ in held or bags])
    truth = np.array([y for _, y in held or bags])

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean())

    lo, hi, golden = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        lo, hi = (lo, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, hi)
    return Model(languages, table, bias, float(np.exp((lo + hi) / 2)))


def document_frequencies(texts: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """How many documents (``text``) there are, and in how many each bucket occurs.

    Tasks put out their sums in ``SLICES`` pieces, which are added up in groups of
    tasks and then as a whole: what the driver gets doesn't grow with the input.
    """
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, salt = np.zeros(size + 1, np.int64), 0, TaskContext.get().partitionId() % SALTS
        for batch in batches:
            own = [t or "" for t in batch["text"].to_pylist()]
            n += len(own)
            for some in groups(own, range(len(own))):
                keys = []
                for h, start in of_texts([code_points(own[k]) for k in some], bits):
                    start = np.minimum(start, len(h))
                    keys.append(np.repeat(np.arange(len(some)), np.diff(np.append(start, len(h)))) * (size + 1) + h)
                keys = np.unique(np.concatenate(keys))
                df += np.bincount(keys % (size + 1), minlength=size + 1)
        if n:
            blobs = [C.pack(np.append(x, n)) for x in np.split(df[:size], SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES)), pa.array(np.full(SLICES, salt)), pa.array(blobs, pa.binary())], names=["slice", "salt", "blob"])
        C.release()

    def add(table: pa.Table) -> pa.Table:
        total = sum(C.unpack(b.as_buffer().to_pybytes())[0] for b in table["blob"])
        return pa.table({"slice": table["slice"][:1], "salt": table["salt"][:1], "blob": pa.array([C.pack(total)], pa.binary())})

    kind = "slice long, salt long, blob binary"
    sums = texts.select("text").mapInArrow(count, kind).groupBy("slice", "salt").applyInArrow(add, kind).groupBy("slice").applyInArrow(add, kind)
    found = {r.slice: C.unpack(bytes(r.blob))[0] for r in sums.collect()}  # at most SLICES rows
    if not found:
        return 0, np.zeros(size)
    return int(found[0][-1]), np.concatenate([found[k][:-1] for k in range(SLICES)]).astype(float)


def learn(docs: DataFrame, modulus: int = 5, held_out: int = 0, sample: int = 2400, room: int = 24_000_000) -> Model:
    """Fit on at most ``sample`` documents, as many of each language as can be had; count n-grams over all.

    Rows are taken in the order of a hash of their id among those outside the
    held-out fold with a language and a text, of each language until they hold its
    part of ``room`` characters (one document at least).  Of more languages than
    ``sample`` the most frequent are learned.
    """
    usable = docs.select("doc_id", "text", "lang").where((C.fold("doc_id", modulus) != held_out) & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    if not counts:
        return Model([], np.zeros(((1 << BITS) + 1, 0)), np.zeros(0), 1.0)
    quota = max(1, sample // len(counts))
    shares = usable.sparkSession.createDataFrame([(r.lang, min(1 << 30, 1 + int((1.3 * quota + 20) / r["n"] * (1 << 30)))) for r in counts], "lang string, share long")
    place = F.xxhash64("doc_id")
    chosen = usable.join(F.broadcast(shares), "lang").where(F.pmod(place, F.lit(1 << 30)) < F.col("share"))
    rows = chosen.select("doc_id", "lang", "text", place.alias("place")).orderBy("place", "doc_id", "lang", "text").limit((2 * quota + 20) * len(counts))
    earlier = Window.partitionBy("lang").orderBy("place", "doc_id", "text")  # of a bounded number of rows
    rows = rows.withColumn("k", F.row_number().over(earlier)).withColumn("before", F.coalesce(F.sum(F.length("text")).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where((F.col("k") <= quota) & (F.col("before") <= room // len(counts))).collect()
    rows.sort(key=lambda r: (r.place, r.doc_id is None, r.doc_id, r.lang, r.text))
    return fit([(r.text, r.lang) for r in rows], document_frequencies(usable, bits_for(len({r.lang for r in rows}))))


def identify(docs: DataFrame, model: Model, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """The likeliest language of every whole text.

    ``und`` with score 0 where the text is null or has no letter, or where no
    language was learned.  Ids play no part in a prediction.
    """
    keep = np.flatnonzero(np.any(model.table != 0, axis=1))
    rows, size = np.ascontiguousarray(model.table[keep], np.float32), model.table.shape[0]
    languages, bias, temperature, bits = model.languages, model.bias, model.temperature, size.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = np.zeros((len(languages), size), np.float32)
        columns[:, keep] = rows.T

        def logits(texts: list[str]) -> np.ndarray:
            points = [code_points(t) for t in texts]
            sizes = np.array([len(p) for p in points])
            sums, total = np.zeros((len(texts), len(languages))), np.zeros(len(texts))
            for order, (h, start) in zip(ORDERS, of_texts(points, bits), strict=True):
                total += np.maximum(sizes - order + 1, 0)
                ok = (sizes > 0) & (start < len(h))
                if ok.any():
                    for k in range(len(languages)):
                        sums[ok, k] += np.add.reduceat(columns[k][h], start[ok], dtype=np.float64)
            return sums / np.maximum(total, 1)[:, None] + bias

        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            for some in groups(texts, [k for k, t in enumerate(texts) if has_letter(t)] if languages else []):
                p = _softmax(logits([texts[k] for k in some]) / temperature)
                best = p.argmax(axis=1)
                for k, b, v in zip(some, best, p[np.arange(len(best)), best], strict=True):
                    names[k], scores[k] = languages[b], float(v)
            keys = batch["doc_id"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([C.crc(x) % modulus == held_out for x in keys], pa.bool_()), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, modulus: int = 5, held_out: int = 0, sample: int = 2400) -> DataFrame:
    """Learn from the rows outside the held-out fold, then predict for all: one row for each row of ``docs``.

    ``und`` with score 0 for null texts, texts without a letter, and all texts where
    no language is known.  Rows without a language or a text teach nothing; a null
    id counts as empty text in the fold.  Equal rows get equal predictions, of
    equally likely languages the first by name.  Other columns play no part.
    """
    return identify(docs, learn(docs, modulus, held_out, sample), modulus, held_out)
