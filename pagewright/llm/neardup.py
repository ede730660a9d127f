"""Near-duplicate vectors by collision counting over one-dimensional projections.

Every vector is projected on many random directions.  Each projection's line is
cut into sorted stretches; vectors that share their stretches in all projections
of one table (a few of them) become candidates, in any of several tables.  For
each candidate pair, the projections in which one lies in the window centred on
the other are counted; pairs with a count that true pairs reach with calibrated
probability are verified by exact cosine.

Counting over all pairs would cost the square of the rows whatever the window;
the tables only decide for which pairs collisions are counted.  Equal vectors
count once, with a weight.

Vectors within less than half the threshold's angle of one centre are all linked.
Where a cell has more than ``heavy`` members, those near its mean become such a
ball, which is compared as one vector with a radius in every cell that one of its
members is in: two balls, or a ball and a vector, are linked as a whole, not at
all, or open.  Open balls are dissolved and the comparison is done again, until
none is open.  A cell that is still large is cut into chunks, and each pair of
chunks is a group of its own: nothing is dropped and no task holds a whole hot
cell.  Groups put out sums per vector and a spanning tree of their links; pairs
only of balls, which may meet in several cells and count once.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import acos, erf, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import vectors
from .components import components

PAIRS = 100_000
BALL = 0.88  # of half the threshold's angle: the largest radius of a ball
SLACK = 1e-9


def least_count(n: int, p: float, recall: float) -> int:
    """The largest count that a binomial variable reaches with at least this probability."""
    if p >= 1:
        return n
    total = 0.0
    for k in range(n + 1):
        total += np.exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(max(p, 1e-300)) + (n - k) * log(1 - p))
        if total > 1 - recall:
            return k
    return n


@dataclass(frozen=True)
class Projections:
    """Directions, cell widths and windows for a cosine threshold, alike for all dimensions."""

    cosine: float
    tables: int = 20
    depth: int = 6
    width: float = 3.2  # of a cell, in standard deviations of a true pair's difference
    window: float = 1.3  # half of it, likewise
    recall: float = 0.999
    seed: int = 11

    @property
    def spread(self) -> float:
        return sqrt(2 - 2 * self.cosine)

    @property
    def needed(self) -> int:
        return least_count(self.tables * self.depth, erf(self.window / sqrt(2)), self.recall)

    def lines(self, unit: np.ndarray) -> np.ndarray:
        """Each vector's place on each line."""
        directions = np.random.default_rng((self.seed, unit.shape[1])).normal(size=(unit.shape[1], self.tables * self.depth))
        return (unit @ directions).astype(np.float32)

    def cells(self, lines: np.ndarray) -> np.ndarray:
        """A hash of each vector's stretches, for each table."""
        step = self.width * self.spread
        shift = np.random.default_rng(self.seed + 1).uniform(0, step, lines.shape[1])
        at = np.floor((lines + shift) / step).astype(np.int64).astype(np.uint64).reshape(len(lines), self.tables, self.depth)
        out = np.broadcast_to(np.arange(1, self.tables + 1, dtype=np.uint64), at.shape[:2]).copy()
        for d in range(self.depth):
            out = C.mix(out * np.uint64(0x9E3779B97F4A7C15) + at[:, :, d])
        return out


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v**2).sum(axis=1, keepdims=True))


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index linked with each of n, directly or not."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def linked(group: np.ndarray, side: np.ndarray, same: np.ndarray, table: np.ndarray, v: np.ndarray, ids: np.ndarray, radius: np.ndarray, p: Projections) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs within groups that pass the count and the cosine, each by the first table they share, and whether
    they are open.  Pairs with a ball pass by the cosine of its centre alone, in each group they share."""
    order = np.lexsort((ids, side, group))
    group, side = group[order], side[order]
    start = C.runs(group)
    size = np.diff(np.append(start, len(group)))
    u = unit(v)
    lines = p.lines(u)
    cells = p.cells(lines)
    ahead = np.concatenate([np.arange(n - 1, -1, -1) for n in size]) if len(size) else np.zeros(0, np.int64)  # members after each row
    total = np.concatenate(([0], np.cumsum(ahead)))
    out_a, out_b, out_open, at, angle = [], [], [], 0, acos(p.cosine)
    while at < len(group):
        upto = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        rows = np.arange(at, upto)
        a = np.repeat(rows, ahead[rows])
        b = C.ranges(rows + 1, rows + 1 + ahead[rows])
        at = upto
        keep = (side[a] != side[b]) | same[order[a]]
        a, b = order[a[keep]], order[b[keep]]
        keep = (radius[a] + radius[b] > 0) | (np.argmax(cells[a] == cells[b], axis=1) == table[a])
        a, b = a[keep], b[keep]
        count = (np.abs(lines[a] - lines[b]) <= np.float32(p.window * p.spread)).sum(axis=1)
        keep = (radius[a] + radius[b] > 0) | (count >= p.needed)
        a, b = a[keep], b[keep]
        cosine, both = np.einsum("ij,ij->i", u[a], u[b]), radius[a] + radius[b]
        least = np.where(both > 0, np.cos(np.maximum(angle - both - SLACK, 0)), p.cosine)
        keep = cosine >= np.where(both > 0, np.cos(np.minimum(angle + both + SLACK, np.pi)), p.cosine)
        out_a.append(a[keep])
        out_b.append(b[keep])
        out_open.append((cosine < least)[keep])
    return (np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_open)) if out_a else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def near_duplicates(rows: DataFrame, cosine: float = 0.95, heavy: int = 1024, projections: Projections | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other vectors found with at least this cosine, equal
    ones included.  Vectors that are null, empty or zero, or hold null or
    non-finite components, link with nothing, nor do vectors of different length
    or without an id.  Rows that share a vec_id are one vector each for links; their
    component is the id's.
    """
    p = projections or Projections(cosine)
    every = rows.select(F.col("vec_id").cast("long").alias("vec_id"))
    ok = vectors.valid(rows).where(F.exists("embedding", lambda x: x != 0))
    classes = C.checkpointed(ok.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")).withColumn("radius", F.lit(0.0)))
    parts = max(8, -(-classes.count() * p.tables // 50_000))
    members, centres = _balls(classes, p, heavy)
    places = C.checkpointed(_in_cells(classes.join(members.select("id"), "id", "left_semi"), p).select("cell", "t", "dim", "id"))
    while True:  # each round that doesn't end it removes a ball
        of_balls = places.join(members, "id").select("cell", "t", "dim", F.col("ball").alias("id")).distinct()
        of_balls = of_balls.join(_in_cells(centres, p).where("t = 0").select("id", "weight", "radius", "v"), "id")
        single = _in_cells(classes.join(members.select("id"), "id", "left_anti"), p)
        found = _compared(single.unionByName(of_balls), p, heavy, parts)
        open_ = found.where("open").select("id").distinct().join(centres.select("id"), "id", "left_semi")
        if open_.isEmpty():
            break
        members = C.checkpointed(members.join(open_.withColumnRenamed("id", "ball"), "ball", "left_anti"))
        centres = C.checkpointed(centres.join(open_, "id", "left_anti"))
    found = found.where("NOT open AND NOT pair").select("id", "n", "root").unionByName(found.where("pair").select("id", "n", "root").distinct())
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    balls = members.select("id", "ball").join(centres.select(F.col("id").alias("ball"), F.col("weight").alias("in_ball")), "ball")
    placed = classes.select("embedding", "id", "weight").join(balls, "id", "left").withColumn("id", F.coalesce("ball", "id")).withColumn("weight", F.coalesce("in_ball", "weight"))
    of_class = placed.join(counts, "id", "left").join(joined, "id", "left").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    told = ok.join(of_class, "embedding").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = every.join(told, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


CELLS = "cell long, t int, id long, weight long, radius double, dim int, v binary"


def _in_cells(entities: DataFrame, p: Projections) -> DataFrame:
    """Each vector once for each table, with its cell."""

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, ids, weight, radius = batch["embedding"], batch["id"].to_numpy(), batch["weight"].to_numpy(), batch["radius"].to_numpy()
            flat, dims = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                v = flat[(ends[at] - dim)[:, None] + np.arange(dim)[None, :]]
                cells = C.mix(p.cells(p.lines(unit(v))) ^ np.uint64(dim)).view(np.int64)
                single = v.astype(np.float32)
                exact = (single.astype(np.float64) == v).all(axis=1)
                blobs = [single[k].tobytes() if e else v[k].tobytes() for k, e in enumerate(exact)]
                for lo in range(0, len(at), 500):
                    few = np.arange(lo, min(lo + 500, len(at)))
                    own = np.repeat(few, p.tables)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cells[few].reshape(-1)),
                            pa.array(np.tile(np.arange(p.tables, dtype=np.int32), len(few))),
                            pa.array(ids[at[own]]),
                            pa.array(weight[at[own]]),
                            pa.array(radius[at[own]]),
                            pa.array(np.full(len(own), dim, np.int32)),
                            pa.array([blobs[x] for x in own], pa.binary()),
                        ],
                        names=["cell", "t", "id", "weight", "radius", "dim", "v"],
                    )

    return entities.select("id", "weight", "radius", "embedding").mapInArrow(spread, CELLS)


def _vectors(blobs: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64).astype(np.float64) for x in blobs.to_pylist()])


def _balls(classes: DataFrame, p: Projections, heavy: int) -> tuple[DataFrame, DataFrame]:
    """(id, ball) of the vectors near the mean of a crowded cell, and the balls as vectors with weight and radius.

    A ball is named by its smallest id.  A vector of several crowded cells goes to one of them.
    """
    spark = classes.sparkSession
    none = spark.createDataFrame([], "id long, ball long"), classes.limit(0)
    placed = _in_cells(classes, p)
    often = C.checkpointed(placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > heavy))
    if often.isEmpty():
        return none
    crowd = placed.join(often, "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / heavy)))

    def add(key, table):
        dim = table["dim"][0].as_py()
        total = (unit(_vectors(table["v"], dim)) * table["weight"].to_numpy()[:, None]).sum(axis=0)
        return pa.table({"cell": [key[0].as_py()], "dim": pa.array([dim], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    def mean(key, table):
        return pa.table({"cell": [key[0].as_py()], "centre": pa.array([unit(_vectors(table["v"], table["dim"][0].as_py()).sum(axis=0)[None, :])[0].tobytes()], pa.binary())})

    sums = crowd.groupBy("cell", "salt").applyInArrow(add, "cell long, dim int, v binary")
    centres = C.checkpointed(sums.groupBy("cell").applyInArrow(mean, "cell long, centre binary"))
    most = BALL * acos(p.cosine) / 2

    def near(batches):
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                some = pa.Table.from_batches([batch]).filter(pa.array(dims == dim))
                u, c = unit(_vectors(some["v"], dim)), _vectors(some["centre"], dim)
                far = np.arccos(np.clip(np.einsum("ij,ij->i", u, c), -1, 1))
                keep = far <= most
                yield pa.RecordBatch.from_arrays([pa.array(some[x].to_numpy()[keep]) for x in ("id", "weight", "cell")] + [pa.array(far[keep])], names=["id", "weight", "cell", "far"])

    close = crowd.select("cell", "id", "weight", "dim", "v").join(centres, "cell").mapInArrow(near, "id long, weight long, cell long, far double")
    chosen = close.groupBy("id", "weight").agg(F.min(F.struct("cell", "far")).alias("c")).select("id", "weight", "c.cell", "c.far")
    chosen = C.checkpointed(chosen)
    balls = chosen.groupBy("cell").agg(F.min("id").alias("ball"), F.sum("weight").alias("weight"), F.max("far").alias("radius"), F.count("*").alias("n")).where("n > 1")

    def as_list(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["ball"], batch["weight"], batch["radius"], pa.array([np.frombuffer(x, np.float64) for x in batch["centre"].to_pylist()], pa.list_(pa.float64()))], names=["id", "weight", "radius", "embedding"])

    vectors_ = balls.join(centres, "cell").select("ball", "weight", "radius", "centre").mapInArrow(as_list, "id long, weight long, radius double, embedding array<double>")
    return C.checkpointed(chosen.select("id", "cell").join(balls.select("cell", "ball"), "cell").select("id", "ball")), C.checkpointed(vectors_.select("embedding", "id", "weight", "radius"))


def _compared(placed: DataFrame, p: Projections, heavy: int, parts: int) -> DataFrame:
    """By group: how many vectors are linked to each and the smallest one linked with it; links of balls as pairs,
    in both directions; and the balls that are open."""
    crowded = C.checkpointed(placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    often = crowded.where(F.col("n") > heavy).withColumn("chunks", F.ceil(F.col("n") / heavy)).select("cell", "chunks")
    placed = placed.join(crowded.select("cell"), "cell", "left_semi").join(often, "cell", "left")
    own = F.pmod(F.xxhash64("id"), F.col("chunks"))
    placed = placed.withColumn("chunk", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1)))
    group = F.xxhash64("cell", F.least("chunk", "other"), F.greatest("chunk", "other"))
    placed = placed.select(group.alias("group"), (F.col("chunk") > F.col("other")).alias("side"), (F.col("chunk") == F.col("other")).alias("same"), "t", "id", "weight", "radius", "dim", "v").withColumn("part", F.pmod(F.xxhash64("group"), F.lit(parts)))

    def compare(table):
        out = ([], [], [], [], [])
        dims = table["dim"].to_numpy()
        for dim in np.unique(dims):
            some = table.filter(pa.array(dims == dim))
            ids, weight, group_, side, same, t, radius = (some[x].to_numpy() for x in ("id", "weight", "group", "side", "same", "t", "radius"))
            a, b, open_ = linked(group_, side, same, t, _vectors(some["v"], dim), ids, radius, p)
            wide = np.unique(np.concatenate((ids[a[open_ & (radius[a] > 0)]], ids[b[open_ & (radius[b] > 0)]])))
            ball = ~open_ & (radius[a] + radius[b] > 0)
            x, y = np.concatenate((a[ball], b[ball])), np.concatenate((b[ball], a[ball]))
            pairs = np.unique(np.stack((ids[x], weight[y], ids[y]), axis=1), axis=0)
            a, b = a[~open_ & ~ball], b[~open_ & ~ball]
            names, at = np.unique(ids, return_inverse=True)
            a2, b2 = at[a], at[b]
            n = np.bincount(a2, weight[b], minlength=len(names)) + np.bincount(b2, weight[a], minlength=len(names))
            hit = np.flatnonzero(n)
            parts_ = (names[hit], n[hit].astype(np.int64), names[labels(len(names), a2, b2)][hit]), tuple(pairs.T), (wide, 0 * wide, wide)
            for kind, columns in enumerate(parts_):
                for x, y in zip(out, (*columns, np.full(len(columns[0]), kind == 1), np.full(len(columns[0]), kind == 2)), strict=True):
                    x.append(y)
        return pa.table({k: pa.array(np.concatenate(x) if x else np.zeros(0, bool if k in ("pair", "open") else np.int64)) for k, x in zip(("id", "n", "root", "pair", "open"), out, strict=True)})

    return C.checkpointed(placed.groupBy("part").applyInArrow(compare, "id long, n long, root long, pair boolean, open boolean"))
