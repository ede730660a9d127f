"""Serving queries: latest value for each key, pages, counts and the cache."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in this order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def on_day(time: Column, day: str, inclusive: bool = False) -> Column:
    """Strictly after midnight and before 23:59:59; ``inclusive`` takes the whole day."""
    start = F.lit(day).cast("timestamp")
    if inclusive:
        return (time >= start) & (time < start + F.expr("INTERVAL 1 DAY"))
    return (time > start) & (time < start + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"))


def records(records_: DataFrame, sessions: DataFrame, details: DataFrame, sellers: DataFrame, prices: DataFrame, price_order: Sequence[Column]) -> DataFrame:
    """Unsold records with session, details, seller if there is one, and the latest price; without a price, none."""
    price = latest(prices, ["record_id"], price_order).select(F.col("record_id").alias("id"), "price", F.col("date_created").alias("price_date"))
    sessions = sessions.select(F.col("id").alias("session_id"), "domain", "locale", "url")
    details = details.select(F.col("record_id").alias("id"), "seller_id", *(F.col(c).alias(f"d_{c}") for c in ("year", "mileage", "fuel_type", "transmission", "date_created")))
    sellers = sellers.select(F.col("id").alias("seller_id"), F.col("name").alias("seller_name"))
    return records_.where("date_sold IS NULL").join(sessions, "session_id").join(details, "id").join(price, "id").join(sellers, "seller_id", "left")


def nested(rows: DataFrame, fallback: bool = False) -> DataFrame:
    """The served shape.  Only a year or mileage of zero takes the details' value; ``fallback`` also fills fuel
    and transmission where the details have none."""
    zero = lambda c: F.when(F.col(c) == 0, F.col(f"d_{c}")).otherwise(F.col(c))
    other = lambda c: F.coalesce(F.nullif(F.col(f"d_{c}"), F.lit("")), F.col(c)) if fallback else F.col(f"d_{c}")
    return rows.select(
        "id",
        F.struct(F.col("make"), F.col("model"), zero("year").alias("year"), zero("mileage").alias("mileage"), other("fuel_type").alias("fuel_type"), other("transmission").alias("transmission")).alias("vehicle"),
        F.struct("domain", "locale", "link").alias("source"),
        F.struct(F.col("seller_id").alias("id"), F.col("seller_name").alias("name")).alias("seller"),
        F.struct("price", F.date_format("price_date", "yyyy-MM-dd").alias("date")).alias("price"),
        F.col("date_created"),
    )


def prices(records_: DataFrame, prices_: DataFrame, day: str | None, price_order: Sequence[Column]) -> DataFrame:
    """All prices of unsold records (records without one stay), or each record's last price on a day."""
    open_ = records_.where("date_sold IS NULL").select("id", "alias")
    price = prices_.select(F.col("record_id").alias("id"), "price", "date_created", *[c for c in prices_.columns if c not in ("record_id", "price", "date_created")])
    if day is None:
        out = open_.join(price, "id", "left")
    else:
        out = open_.join(latest(price.where(on_day(F.col("date_created"), day)), ["id"], price_order), "id")
    return out.select("id", "alias", "price", F.date_format("date_created", "yyyy-MM-dd").alias("date"), "date_created")


def checked(page: int, page_size: int) -> None:
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")


def page_of(rows: DataFrame, order: Sequence[str | Column], page: int = 1, page_size: int = 100) -> DataFrame:
    """One page of an ordered table."""
    checked(page, page_size)
    return rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def page_count(rows: DataFrame, page_size: int = 100, distinct: str | None = None) -> DataFrame:
    """Rows (or distinct values) and how many pages they fill."""
    checked(1, page_size)
    n = F.countDistinct(distinct) if distinct else F.count("*")
    return rows.agg(n.alias("n")).withColumn("pages", F.ceil(F.col("n") / page_size))


def cache_key(scope: str, kind: str) -> str:
    return f"{scope}_{kind}".upper()


def fresh(cache: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Cache rows not older than some days; undated ones stay."""
    return cache.where(F.col("date").isNull() | (F.col("date") >= F.date_sub(as_of, days)))


def latest_cached(cache: DataFrame, keys: Sequence[str], ties: Sequence[Column]) -> DataFrame:
    """The newest entry of each type; an undated one counts as newest."""
    return latest(cache, keys, [F.desc_nulls_first("date"), *ties])


def put_cached(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries of the same type and date are replaced, others stay."""
    own = rows.select(F.col("cache_type").alias("_t"), F.col("date").alias("_d")).distinct()
    kept = cache.join(own, (F.col("cache_type") == F.col("_t")) & F.col("date").eqNullSafe(F.col("_d")), "left_anti")
    return kept.unionByName(rows)


def cached_slice(entries: DataFrame, page: int = 1, page_size: int = 100) -> DataFrame:
    """One page of the array in ``data``."""
    checked(page, page_size)
    return entries.withColumn("data", F.slice("data", (page - 1) * page_size + 1, page_size))


def write_cache(rows: DataFrame, path: str) -> None:
    """Entries into their partitions by type and date; other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_type", "date").parquet(path)


def yesterday(as_of: dt.date) -> str:
    return (as_of - dt.timedelta(days=1)).isoformat()
