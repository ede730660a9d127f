"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for each id in ``edges`` (a, b), component being the smallest id reachable.

    Each round links every node's larger neighbours, then its smaller ones, to the
    smallest node next to it; edges never grow in number and end as stars.  All
    of it are partial minima and equi-joins, so a node with very many neighbours
    is split like any skewed key.  Rounds are checkpointed.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, seen = C.checkpointed(now), None
    for _ in range(rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == seen or not mark["n"]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        seen = (mark["n"], mark["h"])
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        now = C.checkpointed(small.distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
