"""Near-duplicate vectors and components against brute force."""

import random

import numpy as np
import pytest

from pagewright.llm import neardup
from pagewright.llm.components import components


def brute(rows, cosine):
    ok = [(i, np.array(v)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = np.array([v / np.linalg.norm(v) for _, v in ok])
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    parent = list(range(len(ok)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(near)):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    order = {}
    for k in range(len(ok)):
        order.setdefault(root(k), []).append(ok[k][0])
    out = {i: (0, i, True) for i, _ in rows}
    for k, (i, _) in enumerate(ok):
        c = min(order[root(k)])
        out[i] = (int(near[k].sum()), c, c == i)
    return out


def corpus(seed):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(150, 24))
    rows = [*base]
    for k in range(12):
        rows += [base[k] * rnd.uniform(0.5, 3) + rnd.normal(size=24) * 0.03 for _ in range(rnd.integers(1, 30))]
    rows += [base[140]] * 25
    out = [(k, x.astype(np.float32).tolist()) for k, x in enumerate(rows)]
    random.Random(seed).shuffle(out)
    return [*out, (900, None), (901, [0.0] * 24), (902, [None] * 24), (903, [float("nan")] * 24), (904, [float("inf")] + [1.0] * 23)]


@pytest.mark.parametrize(("seed", "heavy"), [(1, 2048), (2, 8)])
def test_against_brute_force(spark, seed, heavy):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cell string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df, heavy=heavy).collect()}
    want = brute(rows, 0.95)
    assert got.keys() == want.keys()
    assert sum(n for n, *_ in got.values()) >= 0.98 * sum(n for n, *_ in want.values())
    assert all(got[i][0] <= want[i][0] for i in got)
    assert sum(got[i][1:] == want[i][1:] for i in got) >= 0.98 * len(got)


def test_balls(spark):
    """Crowded cells become balls; open ones are dissolved; counts stay those of all pairs."""
    rnd = np.random.default_rng(3)
    base, side = rnd.normal(size=(2, 24))
    tight = [base + rnd.normal(size=24) * 0.05 for _ in range(300)]
    loose = [base + side * x + rnd.normal(size=24) * 0.05 for x in np.linspace(0, 0.8, 60)]
    rows = [(k, (x * rnd.uniform(0.1, 9)).tolist()) for k, x in enumerate([*loose, *tight, *rnd.normal(size=(100, 24))])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = neardup.vectors.valid(df).selectExpr("embedding", "vec_id AS id", "1L AS weight", "0.0D AS radius")
    members, centres = neardup._balls(ok, neardup.Projections(0.95), 32)
    assert members.count() > 250 and 0 < centres.count() < 60
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df, heavy=32).collect()}
    want = brute(rows, 0.95)
    assert sum(n for n, *_ in got.values()) >= 0.98 * sum(n for n, *_ in want.values())
    assert all(got[i][0] <= want[i][0] for i in got)
    assert sum(got[i][1:] == want[i][1:] for i in got) >= 0.98 * len(got)


def test_balls_that_come_to_light_late(spark, monkeypatch):
    """Balls found open one after another are all dissolved, however many comparisons that takes."""
    rnd = np.random.default_rng(4)
    base, side = rnd.normal(size=(2, 24))
    crowds = [base + side * x + rnd.normal(size=24) * 0.03 for x in (0, 0.35, 0.7, 1.05) for _ in range(80)]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(crowds)], "vec_id long, embedding array<double>")
    compared, calls = neardup._compared, []

    def one_at_a_time(*args):
        found = compared(*args)
        first = found.where("open").agg({"id": "min"}).first()[0]
        calls.append(first)
        return found.where(f"NOT open OR id = {first}") if first is not None else found

    monkeypatch.setattr(neardup, "_compared", one_at_a_time)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df, heavy=32).collect()}
    want = brute([(k, x.tolist()) for k, x in enumerate(crowds)], 0.95)
    assert len(calls) > 2 and calls[-1] is None
    assert sum(n for n, *_ in got.values()) >= 0.97 * sum(n for n, *_ in want.values())
    assert all(got[i][0] <= want[i][0] for i in got)
    assert sum(got[i][1:] == want[i][1:] for i in got) >= 0.98 * len(got)


def test_links_at_the_edge_of_a_ball(spark):
    """Vectors far beyond the threshold from a ball's centre, linked with the few members at its edge only."""
    rnd = np.random.default_rng(7)
    rows, edge, outer = [], [], []
    for centre, side in rnd.normal(size=(20, 2, 24)):
        centre /= np.linalg.norm(centre)
        side -= (side @ centre) * centre
        side /= np.linalg.norm(side)
        at = lambda degrees: centre * np.cos(np.radians(degrees)) + side * np.sin(np.radians(degrees)) + rnd.normal(size=24) * 0.001  # noqa: B023, E731
        rows += [at(0) for _ in range(100)]
        edge += range(len(rows), len(rows) + 3)
        rows += [at(6.5) for _ in range(3)]
        outer.append(len(rows))
        rows.append(at(24))
    rows = [(k, x.tolist()) for k, x in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = neardup.vectors.valid(df).selectExpr("embedding", "vec_id AS id", "1L AS weight", "0.0D AS radius")
    members, _ = neardup._balls(ok, neardup.Projections(0.95), 64)
    assert members.where(members.id.isin(edge)).count() >= 40
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df, heavy=64).collect()}
    want = brute(rows, 0.95)
    assert all(want[k][0] == 3 for k in outer)
    assert sum(got[k][0] for k in outer) >= 0.9 * 3 * len(outer)
    assert all(got[k][0] <= want[k][0] for k in got)


def test_recall_at_the_threshold():
    rnd = np.random.default_rng(0)
    p, n = neardup.Projections(0.95), 3000
    a = neardup.unit(rnd.normal(size=(n, 64)))
    side = rnd.normal(size=(n, 64))
    side = neardup.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * side
    la, lb = p.lines(a), p.lines(b)
    shared = (p.cells(la) == p.cells(lb)).any(axis=1)
    counted = (np.abs(la - lb) <= p.window * p.spread).sum(axis=1) >= p.needed
    assert (shared & counted).mean() >= 0.93
    far = (np.abs(la[1:] - la[:-1]) <= p.window * p.spread).sum(axis=1) >= p.needed
    assert far.mean() < 0.01


def test_components(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(200, 260)] + [(1, k) for k in range(300, 400)] + [(rnd.randrange(500, 560), rnd.randrange(500, 560)) for _ in range(40)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {k: v for k, v in parent.items() if k in got}
    assert set(parent) - set(got) <= {a for a, b in edges if a == b}


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neardup.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(5, None), (6, [1.0])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(one).collect()} == {(5, 0, 5, True), (6, 0, 6, True)}
