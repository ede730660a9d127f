"""Exact top-k inner products by pivot-table elimination.

The pivot table holds every row's distances to the pivots; with the norms, they
give its inner products with them.  Two bounds on a score come from it.  Rows near
the same pivot make cells: the gap between a query's distances and a cell's range
of distances bounds the whole cell (triangle inequality).  In the cells that are
left, a row's part in the pivots' span is known, and of the rest its length: the
inner product of the parts and the product of the lengths bound each score, for
many queries and rows in one matrix product.  Only pairs whose bound reaches the
query's k-th best score so far are scored.

Queries and candidates meet in blocks: each pair of a query block and a candidate
block is one small task, and only its k best per query go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import vectors

#: Integers below these are exact in single and double precision.
SINGLE, DOUBLE = float(1 << 24), float(1 << 53)
#: Queries that go through a block of candidates together.
QUERIES = 256


def pivots(rows: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Far-apart rows: each next pivot is the row farthest from those before."""
    if not len(rows):
        return rows
    chosen = [int(np.random.default_rng(seed).integers(len(rows)))]
    far = np.linalg.norm(rows - rows[chosen[0]], axis=1)
    while len(chosen) < min(n, len(rows)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(rows - rows[chosen[-1]], axis=1))
    return rows[chosen]


def extent(rows: np.ndarray) -> float:
    """The largest absolute component; the least 64-bit integer has none of its own type."""
    return max(float(rows.max()), -float(rows.min())) if rows.size else 0.0


def narrow(rows: np.ndarray) -> np.ndarray:
    return rows.astype(np.int16) if extent(rows) < 1 << 15 else rows


def distances(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The pivot table; ``Cells.bounds`` allows for its rounding."""
    square = (rows**2).sum(axis=1)[:, None] + (to**2).sum(axis=1)[None, :] - 2 * rows @ to.T
    return np.sqrt(np.maximum(square, 0))


def shadows(rows: np.ndarray, directions: np.ndarray, unit: np.ndarray | float) -> np.ndarray:
    """Each row's part in the pivots' span and the length of the rest, in units of ``unit`` and single precision."""
    inside = rows @ directions
    rest = np.linalg.norm(rows - inside @ directions.T, axis=1)
    return (np.column_stack((inside, rest)) / unit).astype(np.float32)


class Cells:
    """Candidates in the order of their nearest pivot, cut into cells."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, chosen: np.ndarray, kind: type, size: int = 1024):
        self.chosen, self.directions = chosen, np.linalg.qr(chosen.T)[0]
        near = np.concatenate([self._nearest(rows[x : x + size]) for x in range(0, len(rows), size)])
        order = np.lexsort((near[:, 1], near[:, 0]))
        self.ids, self.rows = ids[order], rows[order].astype(kind)
        self.at = [slice(x, min(len(rows), x + size)) for x in range(0, len(rows), size)]
        self.shadows, longest, low, high = [], [], [], []
        for x in self.at:
            v = self.rows[x].astype(np.float64)
            longest.append(float(np.linalg.norm(v, axis=1).max()))
            self.shadows.append(shadows(v, self.directions, longest[-1] or 1.0))
            d = distances(v, chosen)
            low.append(d.min(axis=0, initial=np.inf))
            high.append(d.max(axis=0, initial=0))
        self.longest, self.low, self.high = np.array(longest), np.array(low), np.array(high)
        # Single precision: as many roundings as terms, and a few for the terms themselves.
        self.slack = (self.directions.shape[1] + 16) * 2.0**-23

    def _nearest(self, rows: np.ndarray) -> np.ndarray:
        d = distances(rows.astype(np.float64), self.chosen)
        return np.column_stack((d.argmin(axis=1), d.min(axis=1))) if d.shape[1] else np.zeros((len(rows), 2))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No row of a cell has a higher score than this, for each query and cell."""
        d, norms = distances(queries, self.chosen), np.linalg.norm(queries, axis=1)
        gap = np.zeros((len(queries), len(self.at)))
        for p in range(d.shape[1]):
            np.maximum(gap, np.maximum(self.low[None, :, p] - d[:, p, None], d[:, p, None] - self.high[None, :, p]), out=gap)
        wide = 1e-5 * (norms[:, None] + self.longest[None, :] + np.linalg.norm(self.chosen, axis=1).max(initial=0))
        squares = norms[:, None] ** 2 + self.longest[None, :] ** 2
        most = (squares - np.maximum(gap - wide, 0) ** 2) / 2
        return np.minimum(most, norms[:, None] * self.longest[None, :]) + 1e-9 * squares

    def best(self, own: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of each query's k best rows but those with its id and those below its floor, and how many pairs were scored.

        Places that are left score ``least``.
        """
        asked, least = queries.astype(self.rows.dtype), self.least
        queries = queries.astype(np.float64)
        norms = np.linalg.norm(queries, axis=1)
        norms[norms == 0] = 1
        parts, most = shadows(queries, self.directions, norms[:, None]), self.bounds(queries)
        kept, scores, scored = np.full((len(own), k), C.NULL_ID), np.full((len(own), k), least), 0
        worst = floor.copy()
        space, flags = (np.empty(len(own) * max(map(len, self.shadows)), t) for t in (np.float32, bool))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        met = np.zeros(len(own), bool)

        def merge() -> None:
            """What was found joins the k best; not for each cell, as it sorts k rows for each query met."""
            x, y, found = (np.concatenate(h) for h in zip(*held, strict=True))
            held.clear()
            changed = np.flatnonzero(met)
            met[:] = False
            x, y, found = np.concatenate((np.repeat(changed, k), x)), np.concatenate((kept[changed].reshape(-1), y)), np.concatenate((scores[changed].reshape(-1), found))
            order = np.lexsort((y, -found, x))
            starts = C.runs(x[order])
            first = order[np.arange(len(order)) - C.spread(starts, starts, len(order)) < k]
            kept[changed], scores[changed] = y[first].reshape(-1, k), found[first].reshape(-1, k)
            full = changed[scores[changed, -1] > least]
            worst[full] = scores[full, -1]

        for c in np.argsort(-most.mean(axis=0), kind="stable"):
            who = np.flatnonzero(most[:, c] >= worst)
            if not len(who):
                continue
            ids, rows = self.ids[self.at[c]], self.rows[self.at[c]]
            least_part = worst[who] / (norms[who] * (self.longest[c] or 1.0)) - self.slack
            shape = len(who), len(rows)
            bound = np.matmul(parts[who], self.shadows[c].T, out=space[: shape[0] * shape[1]].reshape(shape))
            reach = np.greater_equal(bound, least_part.astype(np.float32)[:, None], out=flags[: bound.size].reshape(shape))
            pairs = np.flatnonzero(reach.reshape(-1))
            if 8 * len(pairs) > reach.size:
                found = asked[who] @ rows.T
                scored += found.size
                found[ids[None, :] == own[who, None]] = least
                enough = worst[who].astype(np.float32) if found.dtype == np.float32 else worst[who]
                win = found >= enough[:, None]
                if len(rows) > k and np.count_nonzero(win) > 4 * k * len(who):
                    win &= found >= np.partition(found, len(rows) - k, axis=1)[:, len(rows) - k, None]
                x, y = np.nonzero(win)
                found = found[x, y]
            else:
                x, y = np.divmod(pairs, len(rows))
                found = np.einsum("ij,ij->i", asked[who[x]], rows[y])
                scored += len(found)
            x, y = who[x], ids[y]
            new = (y != own[x]) & (found >= floor[x]) & ((found > scores[x, -1]) | (found == scores[x, -1]) & (y < kept[x, -1]))
            if new.any():
                held.append((x[new], y[new], found[new]))
                met[x[new]] = True
                if 4 * sum(len(h[0]) for h in held) >= k * np.count_nonzero(met):
                    merge()
        if held:
            merge()
        return kept, scores, scored

    @property
    def least(self) -> float | int:
        """Below every score."""
        kind = self.rows.dtype
        return kind.type(-np.inf) if kind.kind == "f" else np.int64(np.iinfo(np.int64).min + 1)


def floors(own: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among these rows, or a little less: the k best of more rows score no less."""
    out = np.full(len(own), -np.inf)
    queries, rows = queries.astype(np.float64), rows.astype(np.float64)
    longest, exact = np.linalg.norm(rows, axis=1).max(initial=0), extent(queries) * extent(rows) * queries.shape[1] < DOUBLE
    for x in range(0, len(own) if len(rows) >= k else 0, QUERIES):
        found = queries[x : x + QUERIES] @ rows.T
        found[ids[None, :] == own[x : x + QUERIES, None]] = -np.inf
        out[x : x + QUERIES] = np.partition(found, len(rows) - k, axis=1)[:, len(rows) - k]
    return out if exact else out - (queries.shape[1] + 8) * 2.0**-52 * longest * np.linalg.norm(queries, axis=1)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, n_pivots: int = 64, block: int = 1 << 22, query_block: int = 1 << 18, tasks: int = 24, sample: int = 2048) -> DataFrame:
    """For each query the k candidates with the largest integer inner product; ties go to the smaller vec_id.

    Both have (vec_id, embedding).  Components become floor(scale * x) in double
    precision.  Rows with a null id, or a vector that is null, empty or holds null
    or non-finite components, take no part.  Vectors of different length are not
    compared.  Candidates with the query's vec_id are its own; queries that share
    a vec_id are asked once (the smallest vector).  Pivots come from ``sample``
    rows in the order of a hash of the id; a query's k-th best score among those
    rows is its floor, below which no block looks for its k best.  Scores are exact while they fit 63 bits.

    A block of candidates holds about ``block`` components, one of queries
    ``query_block``: each side is sent once for each block of the other, and a query
    gets k rows from each block of candidates, so blocks are as large as a task can
    well hold.  Smaller tables are cut into up to ``tasks`` blocks of candidates, of
    8192 rows or more.
    """
    whole = lambda df: vectors.valid(df).select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(scale))).alias("v")).withColumn("dim", F.size("v"))
    rows, asked = whole(candidates), whole(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    size = lambda df: df.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    (n, held), (_, held_asked) = size(rows), size(asked)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "v").collect()
    tables: dict[int, np.ndarray] = {}
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r.v) for r in drawn}:
        seeds[dim] = np.array([r.vec_id for r in drawn if len(r.v) == dim], np.int64), narrow(np.array([r.v for r in drawn if len(r.v) == dim], np.int64))
        tables[dim] = pivots(seeds[dim][1].astype(np.float64), n_pivots)
    n_blocks, n_query_blocks = max(1, -(-held // block), min(tasks, -(-n // 8192))), max(1, -(-held_asked // query_block))

    def packed(df: DataFrame, n_own: int, n_other: int, own: str, other: str) -> DataFrame:
        """(own block, dim, ids, vectors; of queries their floors), once for each block of the other side."""

        def run(key, table):
            dim = key[1].as_py()
            v = np.array(table["v"].combine_chunks().flatten().to_numpy(), np.int64).reshape(-1, dim)
            ids = table["vec_id"].to_numpy()
            more = (floors(ids, v, *seeds.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim)))), k),) if own == "q" else ()
            blob = C.pack(ids, narrow(v).reshape(-1), *more)
            return pa.table({own: pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()), "blob": pa.array([blob], pa.binary())})

        df = df.withColumn(own, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_own)))
        return df.groupBy(own, "dim").applyInArrow(run, f"{own} long, dim int, blob binary").withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))))

    left = packed(rows, n_blocks, n_query_blocks, "c", "q").groupBy("dim", "c", "q")
    right = packed(asked, n_query_blocks, n_blocks, "q", "c").groupBy("dim", "c", "q")

    def meet(key, a, b):
        dim, out = key[0].as_py(), ([], [], [])
        if a.num_rows and b.num_rows:
            ids, v = C.unpack(a["blob"][0].as_buffer().to_pybytes())
            own, q, floor = C.unpack(b["blob"][0].as_buffer().to_pybytes())
            v, q = v.reshape(-1, dim), q.reshape(-1, dim)
            largest = extent(v) * extent(q) * dim
            kind = np.float32 if largest < SINGLE else np.float64 if largest < DOUBLE else np.int64
            chosen = tables.get(dim, np.zeros((0, dim)))
            cells = Cells(ids, v, chosen, kind)
            near = np.argsort(distances(q.astype(np.float64), chosen).argmin(axis=1), kind="stable") if len(chosen) else np.arange(len(q))
            for x in range(0, len(q), QUERIES):
                some = near[x : x + QUERIES]
                kept, scores, _ = cells.best(own[some], q[some], k, floor[some])
                real = scores > cells.least
                out[0].append(np.repeat(own[some], real.sum(axis=1)))
                out[1].append(kept[real])
                out[2].append(scores[real].astype(np.int64))
        return pa.table({n: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = left.cogroup(right).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
