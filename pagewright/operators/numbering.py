"""Consecutive numbers over a sorted table without one task that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str = "position") -> tuple[DataFrame, int]:
    """Rows with their position (from 0) in this order, and their number.

    Rows are range partitioned and sorted; each partition's size, one row each,
    gives the next one's start.  Ties need columns that break them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = checkpointed(dealt.withColumn("_part", F.spark_partition_id()))  # ranges are drawn anew in each run
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}  # one row a partition
    start, at = [], 0
    for p in range(parts):
        start.append(at)
        at += sizes.get(p, 0)
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    first = F.element_at(F.array(*(F.lit(x).cast("bigint") for x in start)), F.col("_part") + 1)
    return dealt.withColumn(name, within + first).drop("_part"), at
