"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of all orders (down to the uniform one) are mixed
with weights that depend on how often the longest context was seen, in octaves.
The weights are learned by expectation-maximisation on a deleted part of the
training documents, under counts of the rest.

Counts are exact and cover the whole training text.  Each block of documents
asks for its distinct n-grams once, hash ranges sum what all blocks hold, and
the answers go back to the asking blocks; no count table is ever broadcast.  The
expectation step needs only how many deleted tokens have each combination of
context octave and likelihood ratios (to a quarter octave), so it is summed over
all deleted tokens in one pass and only that bounded table reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BEGIN, END = np.uint64(0x3C6EF372FE94F82B), np.uint64(0x1F83D9ABFB41BD6B)
STEP, ZERO, SHIFT = 4, 0, 400  # ratio codes: steps an octave, the code of nothing, that of one
TOTALS, MAIN, SUMS = 0, 1, 9
MOST = 5  # the highest order whose ratio codes fit a cell's 64 bits


class Stream:
    """A block's documents as symbols: order - 1 begins, the words, one end."""

    def __init__(self, rows: pa.Table, order: int):
        pads = max(1, order - 1)
        data, offsets = C.raw(rows["text"])
        hashes, _, _, before = C.words(data, offsets, lower=True)
        self.n_words = np.diff(before)
        self.offsets = np.concatenate(([0], np.cumsum(self.n_words + pads + 1)))
        n = int(self.offsets[-1])
        index = np.int32 if order * n < 1 << 31 else np.int64
        doc = np.repeat(np.arange(len(self.n_words), dtype=index), self.n_words + pads + 1)
        self.doc, local = doc, (np.arange(n) - self.offsets[doc]).astype(index)
        symbols = np.full(n, BEGIN, np.uint64)
        symbols[local >= pads] = END
        symbols[(local >= pads) & (np.arange(n) < self.offsets[doc + 1] - 1)] = hashes
        self.at = np.flatnonzero(local >= pads).astype(index)
        begin = symbols == BEGIN
        roll, keys, self.from_ = C.Rolling(symbols), [], []
        del hashes, symbols
        self.spots = []
        total = 0
        for j in range(1, order + 1):
            # Shorter ones than the longest also end in the last begin, as contexts; the longest would start before its document there.
            spots = np.flatnonzero(local >= pads - (j < order)).astype(index)
            keys.append(C.mix(roll.of(spots - j + 1, spots + 1) ^ np.uint64(j * 0x632BE59B)))
            where = np.full(n, -1, index)
            where[spots] = np.arange(total, total + len(spots))
            self.spots.append(spots)
            self.from_.append(where)
            total += len(spots)
        del roll, local, where
        keys = np.concatenate(keys)
        by_key = np.argsort(keys).astype(index)
        keys = keys[by_key]
        fresh = np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]
        self.keys, self.which = keys[fresh], np.empty(len(keys), index)
        del keys
        self.which[by_key] = np.cumsum(fresh, dtype=index) - 1
        self.code = np.zeros(len(self.keys), np.uint8)
        for j in range(order, 0, -1):
            self.code[self.which[self.from_[j - 1][self.spots[j - 1]]]] = j
        self.code[self.which[self.from_[0][self.spots[0][begin[self.spots[0]]]]]] = 0

    def counts(self, docs: np.ndarray) -> np.ndarray:
        """Of each distinct n-gram, in these documents (a mask)."""
        taken = np.concatenate([docs[self.doc[x]] for x in self.spots])
        return np.bincount(self.which[taken], minlength=len(self.keys)).astype(np.uint64)

    def of(self, counts: np.ndarray, order: int, at: np.ndarray) -> np.ndarray:
        return counts[self.which[self.from_[order - 1][at]]].astype(np.float64)

    def estimates(self, counts: np.ndarray, total: int, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The octave of each token's longest context and its estimate by each order from 1."""
        out = [self.of(counts, 1, self.at) / max(1, total)]
        context = np.full(len(self.at), float(total))
        for j in range(2, order + 1):
            context = self.of(counts, j - 1, self.at - 1)
            out.append(self.of(counts, j, self.at) / np.maximum(context, 1))
        return octave(context), out


def octave(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.int64)


def mixture(cells: np.ndarray, n: np.ndarray, order: int, rounds: int = 100) -> np.ndarray:
    """Weights [octave, order from 0] by expectation-maximisation over coded cells."""
    octaves, rest, ratios = cells & 63, cells >> 6, [np.ones(len(cells))]
    for _ in range(order):
        code, rest = rest & 1023, rest >> 10
        ratios.append(np.where(code == ZERO, 0.0, 2.0 ** ((code - SHIFT) / STEP)))
    likelihood = np.stack(ratios, axis=1)
    weights = np.full((64, order + 1), 1 / (order + 1))
    for _ in range(rounds):
        share = weights[octaves] * likelihood
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(octaves, share[:, j], minlength=64) for j in range(order + 1)], axis=1).astype(float)
        prior = sums.sum(axis=0) + 1e-3
        sums += prior / prior.sum()  # one token's worth; octaves without any follow all others
        weights = sums / sums.sum(axis=1, keepdims=True)
    weights = np.maximum(weights, 1e-9)
    return weights / weights.sum(axis=1, keepdims=True)


def deleted_interpolation(docs: DataFrame, order: int = 2, modulus: int = 7, held_out: int = 2, deleted: int = 6, block_bytes: int = 8 << 20) -> DataFrame:
    """Score every document; learn from those whose id's crc32 modulo ``modulus`` is not ``held_out``.

    Those with remainder ``deleted`` give the mixture weights, then join the counts.
    Tokens are words with A-Z in lower case, then one end.  A null text is empty
    (one token, the end); a null id hashes as empty text; repeated rows count
    each time.  Without training documents counts are zero and scores finite;
    without a deleted part the weights stay even.  Other columns play no part.
    ``order`` is 1 to ``MOST``.
    """
    if not 1 <= order <= MOST:
        raise ValueError(f"order {order} is not in 1 to {MOST}")
    docs = docs.select("doc_id", "text")
    other = C.fold("doc_id", modulus) != deleted
    packed = C.blocks(docs.where(other), block_bytes)
    few = C.blocks(docs.where(~other), block_bytes).withColumn("block", F.col("block") + F.lit(C.MARKED))
    x = C.exchange_for(packed)

    def ask(block: int, rows: pa.Table) -> Iterator[dict]:
        s = Stream(rows, order)
        counts = s.counts(np.array([C.crc(x) % modulus != held_out for x in rows["doc_id"].to_pylist()], bool))
        bounds = x.cut(s.keys)
        full = np.flatnonzero(np.diff(bounds)).tolist()
        yield {"part": full, "block": [block] * len(full), "blob": [C.pack(*(c[bounds[p] : bounds[p + 1]] for c in (s.keys, counts, s.code)), ascending=1) for p in full]}

    def add(part: int, own: list[int], arrays: list[list[np.ndarray]]) -> Iterator[dict]:
        keys, counts, code = (np.concatenate(x) for x in zip(*arrays, strict=True))
        sizes = [len(a[0]) for a in arrays]
        order_ = np.argsort(keys, kind="stable")
        start = C.runs(keys[order_])
        main = counts * np.repeat(np.array([b < C.MARKED for b in own], np.uint64), sizes)
        told = []
        for c in (counts, main):
            sums = np.add.reduceat(c[order_], start)
            out = np.empty(len(keys), np.uint64)
            out[order_] = C.spread(sums, start, len(keys))
            told.append(out)
        token = code == 1
        kinds = int(np.count_nonzero(np.add.reduceat(counts[order_], start)[code[order_][start] == 1]))
        yield {"block": [-1], "kind": [SUMS], "part": [part], "blob": [C.pack(np.array([main[token].sum(), counts[token].sum(), kinds], np.uint64))]}
        bounds = np.cumsum([0, *sizes])
        for kind, c in ((TOTALS, told[0]), (MAIN, told[1])):
            to = [k for k, b in enumerate(own) if kind == TOTALS or b >= C.MARKED]
            if to:
                yield {"block": [own[k] for k in to], "kind": [kind] * len(to), "part": [part] * len(to), "blob": [C.pack(c[bounds[k] : bounds[k + 1]]) for k in to]}

    every = packed.unionByName(few)
    answers = C.checkpointed(C.gathered(C.each_block(every, ask, C.EVENTS, C.ARROW_EVENTS), add, x))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.array([C.unpack(b.as_buffer().to_pybytes())[0] for b in batch["blob"]], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in sums.T], names=["main", "all", "kinds"])

    sums = answers.where("block = -1").select("blob").mapInArrow(read, "main long, all long, kinds long").agg(*(F.sum(c).alias(c) for c in ("main", "all", "kinds"))).first()
    main_tokens, tokens, kinds = (y or 0 for y in sums)

    def expect(block: int, rows: pa.Table, got: dict) -> pa.Table:
        s = Stream(rows, order)
        cells, by_order = s.estimates(C.codes(got, MAIN, len(s.keys), np.uint64), main_tokens, order)
        for j, f in enumerate(by_order):
            code = np.rint(STEP * np.log2(np.maximum(f * (kinds + 1), 1e-28))) + SHIFT
            cells = cells | (np.where(f > 0, np.clip(code, 1, 1023), ZERO).astype(np.int64) << (6 + 10 * j))
        cell, n = np.unique(cells, return_counts=True)
        return pa.table({"cell": cell, "n": n})

    told = answers.where(F.col("block") >= C.MARKED)
    found = C.answered(few, told.where(F.col("kind") == MAIN), expect, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = mixture(found["cell"].to_numpy(np.int64), found["n"].to_numpy(np.float64), order)

    def score(block: int, rows: pa.Table, got: dict) -> pa.Table:
        s = Stream(rows, order)
        counts = C.codes(got, TOTALS, len(s.keys), np.uint64)
        octaves, by_order = s.estimates(counts, tokens, order)
        p = weights[octaves, 0] / (kinds + 1)
        for j, f in enumerate(by_order, 1):
            p += weights[octaves, j] * f
        c = s.of(counts, 1, s.at)
        doc, n = s.doc[s.at], len(s.n_words)
        add_up = lambda x: np.bincount(doc, x, minlength=n)
        keys = rows["doc_id"].to_pylist()
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "held_out": pa.array([C.crc(x) % modulus == held_out for x in keys], pa.bool_()),
                "n_tokens": s.n_words + 1,
                "n_known": add_up((c > 0).astype(float)).astype(np.int64),
                "train_tokens": np.full(n, tokens, np.int64),
                "base_score": add_up(np.log10((c + 1) / (tokens + kinds + 1))),
                "score": add_up(np.log10(p)),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return C.answered(every, answers.where((F.col("block") >= 0) & (F.col("kind") == TOTALS)), score, schema)
