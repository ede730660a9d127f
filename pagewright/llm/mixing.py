"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent, normalised.  The
exponent is bisected: to a target entropy of the weights, or to the flattest mix
in which no source is passed over more often than a limit.  Weights become token
budgets; each source is read in one random permutation of its documents after
another until its budget is met, and the output runs in blocks that hold every
source in proportion to its weight.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SALTS = 64  # tasks among which a source's documents are dealt where the sources are many


def weights_at(tokens: np.ndarray, exponent: float) -> np.ndarray:
    w = np.exp(exponent * (np.log(tokens) - np.log(tokens.max())))
    return w / w.sum()


def entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def passes(tokens: np.ndarray, w: np.ndarray) -> float:
    """How often the most repeated source is read if the least repeated one is read once."""
    times = w / tokens
    return float(times.max() / times.min())


def bisect(tokens: np.ndarray, target_entropy: float | None, most_passes: float | None, rounds: int = 100) -> float:
    """The exponent in [0, 1] (1: natural shares, 0: even) that meets the target or keeps to the limit.

    An entropy below that of the natural shares gives 1, one above the even mix's 0.
    """
    if len(tokens) < 2:
        return 1.0

    def too_flat(x: float) -> bool:
        w = weights_at(tokens, x)
        return entropy(w) > target_entropy if target_entropy is not None else passes(tokens, w) > most_passes

    if not too_flat(0.0):
        return 0.0
    lo, hi = 0.0, 1.0  # too flat at lo
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if too_flat(mid) else (lo, mid)
    return hi


def planned(sums: DataFrame, target_entropy: float | None, most_passes: float | None, budget: int | None, rounds: int = 50) -> DataFrame:
    """(s, tokens, w, due) of a table of sources of any size: the same bisection, with sums over the table."""
    ends = sums.agg(F.min("tokens"), F.max("tokens")).first()
    least, most = float(ends[0]), float(ends[1])
    share = F.log(F.col("tokens") / F.lit(most))

    def moments(a: float) -> tuple[float, float]:
        """The sum of the weights before they are normalised, and the weights' entropy."""
        w = F.exp(F.lit(a) * share)
        r = sums.agg(F.sum(w), F.sum(w * share)).first()
        return float(r[0]), float(np.log(r[0]) - a * r[1] / r[0])

    def too_flat(a: float) -> bool:
        return moments(a)[1] > target_entropy if target_entropy is not None else (most / least) ** (1 - a) > most_passes

    lo, hi = 0.0, 1.0
    if not too_flat(0.0):
        hi = 0.0
    for _ in range(rounds if hi else 0):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if too_flat(mid) else (lo, mid)
    scale = moments(hi)[0]
    w = F.exp(F.lit(hi) * share) / F.lit(scale)
    return sums.select("s", "tokens", w.alias("w"), F.greatest(F.lit(0), F.round(w * F.lit(float(budget) if budget is not None else scale * most))).cast("long").alias("due"))


def n_tokens(text: Column) -> Column:
    """Words between blanks, and one for the end of the document."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1


def mixed(docs: DataFrame, target_entropy: float | None = None, most_passes: float | None = 2.0, budget: int | None = None, block: int = 1 << 20, seed: int = 0, slices: int | None = None, most_sources: int = 100_000) -> DataFrame:
    """All columns of ``docs`` plus epoch, mix_weight, n_tokens and mix_block, one row for each reading of a document.

    Without ``budget`` the total is such that the least repeated source is read
    exactly once, so that no document is lost; others repeat up to ``most_passes``
    times.  With a smaller budget the last pass over a source is cut: a document is
    read if it starts within its source's budget.  ``mix_block`` numbers stretches
    of about ``block`` tokens of the output, each with all sources by weight.

    A null source is one of its own.  A null text counts as one token.  Repeated
    rows are read each.  Columns of ``docs`` named like the new ones give way.  A
    permutation is cut into ``slices`` (four for each shuffle partition, 256 at
    least), so that no source meets in one task; rows alike in doc_id and text fall
    into one slice of it.  The table of sources goes to the driver if it has at most
    ``most_sources``; beyond, its sums are taken where it is.
    """
    if (target_entropy is None) == (most_passes is None):
        raise ValueError("one of target_entropy and most_passes")
    new = ["epoch", "mix_weight", "n_tokens", "mix_block"]
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in new))
    own, spark, x = docs.columns, docs.sparkSession, "_mix_"
    while any(c.lower().startswith(x) for c in own):
        x = "_" + x
    n, row, source, epoch, slice_, place, at = (x + y for y in ("n", "row", "source", "epoch", "slice", "place", "at"))
    sums = checkpointed(docs.groupBy(F.col("source").cast("string").alias("s")).agg(F.sum(n_tokens(F.col("text"))).cast("long").alias("tokens")))
    few = sums.orderBy("s").limit(most_sources + 1).collect()
    due = docs.withColumns({n: n_tokens(F.col("text")).cast("long"), row: F.xxhash64("doc_id", "text")})
    if len(few) <= most_sources:
        tokens = np.array([r.tokens for r in few], float)
        w = weights_at(tokens, bisect(tokens, target_entropy, most_passes)) if few else tokens
        total = float(budget) if budget is not None else float((tokens / w).max(initial=0))
        plan = spark.createDataFrame([(r.s, k, int(r.tokens), float(y), max(0, round(y * total))) for k, (r, y) in enumerate(zip(few, w, strict=True))], f"{x}s string, {source} long, {x}tokens long, {x}w double, {x}due long")
        due = due.join(F.broadcast(plan), F.col("source").cast("string").eqNullSafe(F.col(x + "s")))
    else:
        plan = planned(sums, target_entropy, most_passes, budget).select(F.col("s").alias(x + "s"), F.xxhash64("s").alias(source), F.col("tokens").alias(x + "tokens"), F.col("w").alias(x + "w"), F.col("due").alias(x + "due"))
        plan = plan.withColumn(x + "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        due = due.withColumn(x + "of", F.pmod(F.col(row), F.lit(SALTS))).join(plan, F.col("source").cast("string").eqNullSafe(F.col(x + "s")) & (F.col(x + "of") == F.col(x + "salt")))
    due = due.where(F.col(x + "due") > 0)
    due = due.withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(x + "due") - 1) / F.col(x + "tokens")))))
    # a permutation is the order of a hash; its slices' sums place them one after another
    slices = slices or max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    due = due.withColumn(place, F.xxhash64(F.lit(seed), F.col(epoch), F.col(row)))
    due = due.withColumn(slice_, F.pmod(F.shiftright(place, 33), F.lit(slices)))
    sizes = due.groupBy(source, epoch, slice_).agg(F.sum(n).alias(x + "size"))
    ahead = Window.partitionBy(source, epoch).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(source, epoch, slice_, F.coalesce(F.sum(x + "size").over(ahead), F.lit(0)).alias(x + "before"))
    within = Window.partitionBy(source, epoch, slice_).orderBy(place, row).rowsBetween(Window.unboundedPreceding, -1)
    due = due.withColumn(at, F.coalesce(F.sum(n).over(within), F.lit(0))).join(sizes, [source, epoch, slice_])
    due = due.withColumn(at, F.col(epoch) * F.col(x + "tokens") + F.col(x + "before") + F.col(at)).where(F.col(at) < F.col(x + "due"))
    return due.select(
        *(F.col(f"`{c}`") for c in own),
        F.col(epoch).cast("int").alias("epoch"),
        F.col(x + "w").alias("mix_weight"),
        F.col(n).alias("n_tokens"),
        F.floor(F.col(at) / F.greatest(F.lit(1.0), F.col(x + "w") * block)).cast("long").alias("mix_block"),
    )
