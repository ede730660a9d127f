"""What the serving layer answers: one page of records or prices, from the cache where it has them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import serving


class BadRequest(ValueError):
    """A page that isn't there, or a parameter that makes no sense."""


@dataclass(frozen=True)
class Answer:
    label: str
    rows: DataFrame


def valid_day(day: str | None, as_of: Column, rows: DataFrame) -> str | None:
    """A date parameter as year-month-day, not after the day before ``as_of``."""
    if day is None:
        return None
    from ..functions.scalars import api_date

    found = rows.sparkSession.range(1).select(api_date(F.lit(day), as_of).cast("string")).first()[0]
    if found is None:
        raise BadRequest(f"no such day: {day}")
    return found


def one_page(label: str, rows: DataFrame, order: list, page: int = 1, page_size: int = 100) -> Answer:
    """A page of rows under its label; a later page without rows is a bad request."""
    try:
        out = serving.page_of(rows, order, page, page_size)
    except ValueError as e:
        raise BadRequest(str(e)) from e
    if page > 1 and out.isEmpty():
        raise BadRequest(f"page {page} has no rows")
    return Answer(label, out)


def cached_first(cache: DataFrame, cache_type: str, day: str | None, compute: Callable[[], DataFrame]) -> DataFrame:
    """The newest cached rows of a type (of a day, if given), exploded; computed where there are none.

    Cache rows are (id, cache_type, date, data), data being an array of served structs.
    """
    own = cache.where(F.col("cache_type") == cache_type)
    own = own.where(F.col("date") == F.lit(day).cast("date")) if day else own
    newest = serving.latest_cached(own, ["cache_type"], [F.desc("id")])
    if newest.isEmpty():
        return compute()
    return newest.select(F.explode("data").alias("row")).select("row.*")


def refreshed(cache: DataFrame, entries: DataFrame, as_of: Column, days: int) -> DataFrame:
    """The cache after its batch job: what is too old goes, entries of the same type and date are replaced."""
    return serving.put_cached(serving.fresh(cache, as_of, days), entries)


def entry(rows: DataFrame, cache_type: str, day: Column, order: list[str]) -> DataFrame:
    """All served rows of a table as one cache entry, in this order."""
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    data = F.transform(F.sort_array(F.collect_list(F.struct(*(F.col(c).alias(f"_{k}") for k, c in enumerate(order)), whole.alias("row")))), lambda x: x["row"])
    return rows.agg(data.alias("data")).select(F.lit(0).cast("long").alias("id"), F.lit(cache_type).alias("cache_type"), day.cast("date").alias("date"), "data")
