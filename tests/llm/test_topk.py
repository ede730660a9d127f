"""Exact top-k against a full sort."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import topk
from pagewright.llm.topk import top_k


def brute(rows, asked, k, scale=64):
    whole = {}
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for i, v in ok:
        if asked(i):
            whole[i] = min(v, whole.get(i, v))
    out = []
    for i, q in whole.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 1e7])
def test_against_full_sort(spark, size):
    rnd = np.random.default_rng(7)
    v = rnd.normal(size=(400, 8)) * size
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    rows += [(1000 + k, rows[20][1]) for k in range(60)]  # ties
    rows += [(2000, None), (2020, [1.0, None] + [0.0] * 6), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (None, rows[3][1]), (2080, []), (2100, [1.0, 2.0]), (2101, [3.0, 1.0]), (40, rows[41][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = top_k(df, df.where("vec_id % 20 = 0"), k=7, block=64, query_block=8)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 20 == 0, 7)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, df).count() == 0


def eliminated(ids, rows, own, queries, k, n_pivots, kind, floor=None, size=128):
    """(query's id, vec_id, score) by ``Cells``, and the share of pairs that were scored."""
    cells = topk.Cells(ids, rows, topk.pivots(rows[::2].astype(np.float64), n_pivots), kind, size)
    kept, scores, scored = cells.best(own, queries, k, np.full(len(own), -np.inf) if floor is None else floor)
    return [[(int(j), int(s)) for j, s in zip(*x) if s > cells.least] for x in zip(kept, scores)], scored / (len(ids) * len(own))


def sorted_out(ids, rows, own, queries, k):
    exact = [[(-sum(int(a) * int(b) for a, b in zip(q, v)), int(j)) for j, v in zip(ids, rows) if j != i] for i, q in zip(own, queries)]
    return [[(j, -s) for s, j in sorted(x)[:k]] for x in exact]


def test_few_pairs_are_scored():
    """Vectors alike in length and spread evenly, of which distances to pivots rule out next to none by the triangle inequality."""
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(4000, 64))
    rows = np.floor(64 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    ids, asked = rnd.permutation(4000), np.arange(40)
    floor = topk.floors(ids[asked], rows[asked], ids[:2000], rows[:2000], 20)
    got, share = eliminated(ids, rows, ids[asked], rows[asked], 20, 64, np.float32, floor, 1024)
    assert got == sorted_out(ids, rows, ids[asked], rows[asked], 20)
    assert share < 0.03


def test_cells_far_away_are_left_out():
    rnd = np.random.default_rng(4)
    rows = np.repeat(np.eye(8, 16) * 1000, 200, axis=0).astype(np.int64) + rnd.integers(-9, 10, (1600, 16))
    got, share = eliminated(np.arange(1600), rows, np.arange(0, 1600, 50), rows[::50], 5, 8, np.float64)
    assert got == sorted_out(np.arange(1600), rows, np.arange(0, 1600, 50), rows[::50], 5)
    assert share < 0.3


@pytest.mark.parametrize("n_pivots", [0, 1, 5, 12])
@pytest.mark.parametrize("case", ["plain", "copies", "lengths", "huge", "negative", "zero"])
def test_elimination_loses_nothing(case, n_pivots):
    rnd = np.random.default_rng(5)
    rows, kind = rnd.integers(-40, 41, (700, 12)), np.float32
    if case == "copies":
        rows[100:600] = rows[100]
    elif case == "lengths":
        rows, kind = np.floor(rows * 10.0 ** rnd.uniform(-2, 5, (700, 1))).astype(np.int64), np.float64
    elif case == "huge":
        rows, kind = rows * 10_000_000 + rnd.integers(-3, 4, rows.shape), np.int64
    elif case == "negative":
        rows = -np.abs(rows)
        rows[::20] *= -1
    elif case == "zero":
        rows[::3] = 0
    ids = rnd.permutation(700) // 2  # some share an id
    own, queries = ids[::20], rows[::20]
    want = sorted_out(ids, rows, own, queries, 9)
    floor = topk.floors(own, queries, ids[:60], rows[:60], 9)
    assert all(f <= w[-1][1] for f, w in zip(floor, want)) and np.isfinite(floor).all()
    assert eliminated(ids, rows, own, queries, 9, n_pivots, kind)[0] == want
    assert eliminated(ids, rows, own, queries, 9, n_pivots, kind, floor)[0] == want


def test_few_rows():
    """Fewer rows than asked for, and fewer in the sample."""
    rows = np.arange(12).reshape(6, 2) - 5
    assert topk.floors(np.arange(6), rows, np.arange(6), rows, 6).tolist() == [-np.inf] * 6
    assert eliminated(np.arange(6), rows, np.arange(6), rows, 6, 2, np.float32)[0] == sorted_out(np.arange(6), rows, np.arange(6), rows, 6)


def test_least_integer_is_not_narrowed():
    rows = np.array([[np.iinfo(np.int64).min, 3], [1, 2]])
    assert topk.extent(rows) == 2.0**63 and topk.narrow(rows).tolist() == rows.tolist()


@pytest.mark.parametrize("sample", [0, 3, 30, 400])
def test_any_sample(spark, sample):
    rnd = np.random.default_rng(8)
    rows = [(k, x.tolist()) for k, x in enumerate(rnd.normal(size=(300, 6)))]
    rows += [(k, [0.5, 0.25]) for k in range(300, 330)] + [(k, rows[40][1]) for k in range(340, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(df, df.where("vec_id % 20 = 0"), k=7, block=256, query_block=16, sample=sample, n_pivots=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 20 == 0, 7)
