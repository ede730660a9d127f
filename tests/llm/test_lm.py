"""Deleted interpolation against a plain count-and-mix version."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import common
from pagewright.llm.lm import Stream, deleted_interpolation, mixture


def corpus(n=120):
    rnd = random.Random(3)
    vocabulary = ["ab", "Cd", "é,", "fgh", "i", "jk", "lm.", "no", "pq", "rs"]
    out = []
    for k in range(n):
        words, w = [], 0
        for _ in range(rnd.randrange(0, 60)):
            w = (w * 3 + rnd.choice([1, 1, 1, 2, 5])) % 10
            words.append(vocabulary[w])
        out.append((k, rnd.choice([" ", "\n", "\t "]).join(words)))
    return [*out, (500, None), (501, ""), (502, "ÀB àb"), (None, "ab Cd")]


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


def grams(text, order):
    """Each token's n-grams of all orders, the longest last, and its contexts likewise."""
    pads = max(1, order - 1)
    symbols = ["<s>"] * pads + tokens(text)
    for k in range(pads, len(symbols)):
        yield [tuple(symbols[k - j + 1 : k + 1]) for j in range(1, order + 1)], [tuple(symbols[k - j + 1 : k]) for j in range(1, order + 1)]


def counted(texts, order):
    n, contexts = Counter(), Counter()
    for text in texts:
        for own, before in grams(text, order):
            n.update(own)
            contexts.update(before)
    return n, contexts


def brute(rows, order, rounds=100):
    """Scores by counting, and expectation-maximisation token by token; ratios are rounded as the operator states."""
    fold = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 for d, _ in rows]
    train = [t for (_, t), f in zip(rows, fold, strict=True) if f != 2]
    main = [t for (_, t), f in zip(rows, fold, strict=True) if f not in (2, 6)]
    kinds = len({x for t in train for x in tokens(t)})

    def told(text, n, contexts):
        for own, before in grams(text, order):
            seen = contexts[before[-1]]
            yield (int(math.log2(seen)) + 1 if seen else 0), [n[g] / max(1, contexts[c]) for g, c in zip(own, before, strict=True)]

    cells = []
    n, contexts = counted(main, order)
    for (_, text), f in zip(rows, fold, strict=True):
        if f == 6:
            for seen, by_order in told(text, n, contexts):
                cells.append((seen, [1.0] + [2 ** (round(4 * math.log2(p * (kinds + 1))) / 4) if p else 0.0 for p in by_order]))
    weights = {k: [1 / (order + 1)] * (order + 1) for k in range(64)}
    for _ in range(rounds):
        sums = {k: [0.0] * (order + 1) for k in weights}
        for seen, likelihood in cells:
            share = [w * x for w, x in zip(weights[seen], likelihood, strict=True)]
            for j, x in enumerate(share):
                sums[seen][j] += x / sum(share)
        prior = [sum(x[j] for x in sums.values()) + 1e-3 for j in range(order + 1)]
        for k in weights:
            own = [x + y / sum(prior) for x, y in zip(sums[k], prior, strict=True)]
            weights[k] = [x / sum(own) for x in own]
    n, contexts = counted(train, order)
    out = {}
    for d, text in rows:
        out[d] = sum(math.log10(sum(w * x for w, x in zip(weights[seen], [1 / (kinds + 1), *by_order], strict=True))) for seen, by_order in told(text, n, contexts))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in deleted_interpolation(df, order=order).collect()}
    crc = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 for d, _ in rows}
    train = Counter(t for d, text in rows if crc[d] != 2 for t in tokens(text))
    n, v, want = sum(train.values()), len(train), brute(rows, order)
    assert len(got) == len(rows)
    for d, text in rows:
        r, ts = got[d], tokens(text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc[d] == 2, len(ts), sum(t in train for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
        assert math.isclose(r.score, want[d], rel_tol=1e-6), (d, r.score, want[d])
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) or order == 1


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_keys_do_not_depend_on_what_a_worker_did_before(monkeypatch, order):
    """A block asks and reads its answers in workers that have met larger blocks, or none: its n-grams are the same."""
    rows = pa.table({"doc_id": [1, 2, 3], "text": ["a b a", "", "b c"]})
    every = common.powers(1 << 20)
    told = []
    for size in (100, 1000):
        monkeypatch.setattr(common, "_powers", [x[:size] for x in every])
        s = Stream(rows, order)
        told.append((s.keys.tolist(), s.counts(np.ones(3, bool)).tolist(), s.code.tolist()))
    assert told[0] == told[1]


def test_counts_of_uneven_blocks(spark):
    """Short texts, then one of over 2**20 symbols, each a block: the short ones' counts are not mixed up."""
    rnd = random.Random(9)
    rows = [(k, " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(40)) for _ in range(1_100_000 if k == 11 else 2000))) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id")
    got = {r.doc_id: r for r in deleted_interpolation(df, block_bytes=4096).collect()}
    ts = {d: Counter(tokens(text)) for d, text in rows}
    train = sum((c for d, c in ts.items() if zlib.crc32(str(d).encode()) % 7 != 2), Counter())
    n, v = sum(train.values()), len(train)
    for d, c in ts.items():
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (sum(c.values()), sum(m for t, m in c.items() if t in train), n)
        assert math.isclose(got[d].base_score, sum(m * math.log10((train[t] + 1) / (n + v + 1)) for t, m in c.items()), rel_tol=1e-9)


def test_order_is_checked(spark):
    for order in (0, 6):
        with pytest.raises(ValueError, match="order"):
            deleted_interpolation(spark.createDataFrame([], "doc_id long, text string"), order=order)


def test_probabilities_of_a_context_sum_to_one(spark):
    """Scores of all continuations of one training context add up to at most one."""
    rows = [(k, "a b") for k in range(40)] + [(k, "a c") for k in range(40, 50)]
    df = spark.createDataFrame([*rows, (1000, "a"), (1001, "a b")], "doc_id long, text string")
    got = {r.doc_id: 10**r.score for r in deleted_interpolation(df).collect()}
    assert 0 < got[1000] < got[1001] < 1
    assert sum({rows[d][1] if d < 50 else d: p for d, p in got.items() if d != 1001}.values()) < 1


def test_mixture_prefers_what_predicts():
    cells = np.array([5 | (400 + 8) << 6 | (400 + 40) << 16, 0 | (400 + 8) << 6])
    w = mixture(cells, np.array([100.0, 100.0]), 2)
    assert w[5, 2] > 0.9 and w[0, 2] < 0.05 and np.allclose(w.sum(axis=1), 1)


def test_empty(spark):
    assert deleted_interpolation(spark.createDataFrame([], "doc_id long, text string")).count() == 0
