"""Vector columns as packed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: Column) -> Column:
    """Not null or empty, and every component finite."""
    return F.coalesce(column.isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles), those that take part."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
