"""Mixing: the bisected exponent, budgets, permutations, and a plain re-count of each row's place."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import mixing


def corpus(seed=1):
    rnd, out = random.Random(seed), []
    for source, n in (("a", 120), ("b", 30), ("c", 8), (None, 12)):
        out += [(len(out) + k, " ".join(["w"] * rnd.randrange(0, 40)), source, "kept") for k in range(n)]
    return [*out, (900, None, "a", "kept"), (901, "", "c", "kept"), (5, out[5][1], "a", "kept"), (None, "x y", "b", "kept")]


@pytest.mark.parametrize("tokens", [[100.0, 10, 1], [7.0, 7], [5.0], [1e12, 1, 3]])
def test_exponent(tokens):
    tokens = np.array(tokens)
    x = mixing.bisect(tokens, None, 2.0)
    assert mixing.passes(tokens, mixing.weights_at(tokens, x)) <= 2 + 1e-9
    if len(set(tokens)) > 1:
        assert mixing.passes(tokens, mixing.weights_at(tokens, x - 1e-6)) > 2
        even, natural = np.log(len(tokens)), mixing.entropy(mixing.weights_at(tokens, 1.0))
        y = mixing.bisect(tokens, (even + natural) / 2, None)
        assert mixing.entropy(mixing.weights_at(tokens, y)) == pytest.approx((even + natural) / 2)
    assert mixing.bisect(tokens, 99.0, None) == (0.0 if len(tokens) > 1 else 1.0)


@pytest.mark.parametrize("how", [{"most_passes": 2.5}, {"target_entropy": 1.2, "most_passes": None}, {"most_passes": 3.0, "budget": 900}, {"most_passes": 2.5, "most_sources": 1}, {"target_entropy": 1.2, "most_passes": None, "most_sources": 0}, {"most_passes": 3.0, "budget": 900, "most_sources": 2}])
def test_places(spark, how):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, epoch string").repartition(3)
    got = mixing.mixed(df, block=200, slices=4, **how).collect()
    n = {"a": 0, "b": 0, "c": 0, None: 0}
    for _, t, s, _ in rows:
        n[s] += len((t or "").split()) + 1
    names, tokens = list(n), np.array(list(n.values()), float)
    x = mixing.bisect(tokens, how.get("target_entropy"), how.get("most_passes"))
    w = mixing.weights_at(tokens, x)
    total = how.get("budget") or (tokens / w).max()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.mix_weight == pytest.approx(w[names.index(r.source)])
        assert r.n_tokens == len((r.text or "").split()) + 1
    for s, share, size in zip(names, w, tokens):
        due = round(share * total)
        read = sum(r.n_tokens for r in by[s])
        assert due <= read < due + 40  # the last document started within the budget
        whole = sum(1 for r in rows if r[2] == s)
        for e in range(int(due // size)):
            assert sum(1 for r in by[s] if r.epoch == e) == whole
        assert max(r.mix_block for r in by[s]) == pytest.approx(due / (share * 200), abs=1 + 40 / (share * 200))
    if "budget" not in how:
        assert {(r.doc_id, r.text) for r in got} == {r[:2] for r in rows}
        assert {r.epoch for r in by["a"]} == {0}


def test_order_is_a_permutation_of_each_pass(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string, x string")
    got = mixing.mixed(df, most_passes=4.0, block=50).where("source = 'c'").collect()
    orders = [[r.doc_id for r in sorted(got, key=lambda r: r.mix_block) if r.epoch == e] for e in (0, 1)]
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(df).count() == 0
    assert mixing.mixed(df.withColumn("mix_weight", F.lit(1)), target_entropy=1.0, most_passes=None).columns[-4:] == ["epoch", "mix_weight", "n_tokens", "mix_block"]
