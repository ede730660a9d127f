"""Which pages to fetch next, and in which order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ("registration_number", "vin_number", "sdk")


def _pending(records: DataFrame, sessions: DataFrame, details: DataFrame) -> DataFrame:
    """Unsold records with a link and without details, with their session's domain and locale."""
    sessions = sessions.select(F.col("id").alias("session_id"), "domain", "locale", "run_id")
    open_ = records.where("date_sold IS NULL AND link IS NOT NULL").join(sessions, "session_id")
    return open_.join(details.select(F.col("record_id").alias("id")), "id", "left_anti")


def priority(records: DataFrame, sessions: DataFrame, details: DataFrame, as_of: Column, days: int = 2) -> DataFrame:
    """Records younger than the window."""
    rows = _pending(records, sessions, details).where(F.col("date_created") > as_of - F.make_dt_interval(F.lit(days)))
    return rows.select("id", "link", "domain", "locale", "date_created")


def backlog(records: DataFrame, sessions: DataFrame, details: DataFrame, as_of: Column, days: int = 2, platforms: Sequence[str] = (), of_platforms: bool = True) -> DataFrame:
    """Records older than the window, of platform domains or of all others; without platforms, all either way."""
    rows = _pending(records, sessions, details).where(F.col("date_created") <= as_of - F.make_dt_interval(F.lit(days)))
    if platforms:
        known = F.col("domain").isin(*platforms)
        rows = rows.where(known if of_platforms else ~known)
    return rows.select("id", "link", "domain", "locale", "date_created")


def inconclusive(records: DataFrame, sessions: DataFrame, details: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """Unsold records whose details hold none of the identity fields."""
    blank = details.select(F.col("record_id").alias("id"), *identity)
    for c in identity:
        blank = blank.where(F.col(c).isNull())
    sessions = sessions.select(F.col("id").alias("session_id"), "domain", "locale")
    rows = records.where("date_sold IS NULL AND link IS NOT NULL").join(blank.select("id"), "id").join(sessions, "session_id")
    return rows.select("id", "link", "domain", "locale", "date_created")


def queued(queues: Sequence[DataFrame]) -> DataFrame:
    """The queues one after another; a record of two queues stays in both."""
    out = [q.withColumn("queue", F.lit(k)) for k, q in enumerate(queues)]
    joined = out[0]
    for q in out[1:]:
        joined = joined.unionByName(q)
    return joined


def by_domain(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each domain's rows as one ordered list of (link, id)."""
    keys = [F.col(c).alias(f"_{k}") for k, c in enumerate(order)]
    items = F.sort_array(F.collect_list(F.struct(*keys, "link", "id")))
    return rows.groupBy("domain").agg(F.transform(items, lambda x: F.struct(x["link"].alias("link"), x["id"].alias("id"))).alias("items"))


def expand_locales(domains: DataFrame, run_id: int, proxies: int) -> DataFrame:
    """One work item for each locale of a domain, with a proxy dealt round-robin (null without proxies)."""
    rows = domains.select("domain", F.posexplode("locales").alias("k", "locale"))
    place = F.row_number().over(Window.orderBy("domain", "k")) - 1  # a list of domains, not of records
    return rows.withColumn("proxy", (place + run_id) % proxies if proxies else F.lit(None).cast("int")).drop("k")


def batches(rows: DataFrame, order: Sequence[str | Column], batch_size: int, pool_size: int, total: int | None = None) -> DataFrame:
    """Waves of batch_size * pool_size items, dealt round-robin to the wave's batches; the last batch takes what is over.

    Positions are numbered over range partitions, not in one task.
    """
    from .numbering import numbered

    rows, n = numbered(rows, order)
    n = n if total is None else total
    wave, pool = batch_size * pool_size, F.lit(pool_size)
    last = max(0, -(-n // batch_size) - 1)
    spot = F.col("position")
    batch = F.floor(spot / wave) * pool_size + (spot % wave) % pool
    return rows.withColumn("batch", F.least(batch, F.lit(last)).cast("bigint"))


def interleave(sizes: dict[str, int]) -> list[str]:
    """A fair order of domains: the largest is the backbone, the others, arranged likewise, fill its gaps evenly, earlier gaps first."""
    groups = sorted((g for g in sizes.items() if g[1]), key=lambda g: -g[1])
    return _arranged([[f"{name}{k + 1}" for k in range(n)] for name, n in groups])


def _arranged(groups: list[list[str]]) -> list[str]:
    if len(groups) < 2:
        return groups[0] if groups else []
    backbone, rest = groups[0], _arranged(groups[1:])
    each, more = divmod(len(rest), max(1, len(backbone) - 1))
    out, at = [], 0
    for k, item in enumerate(backbone):
        out.append(item)
        take = each + (k < more)
        out += rest[at : at + take]
        at += take
    return out


def fair_order(rows: DataFrame, order: Sequence[str], key: str = "domain") -> DataFrame:
    """A distributed fair order: each domain's items at even distances (``turn`` in 0 to 1)."""
    n = F.count("*").over(Window.partitionBy(key))
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("turn", (k - 0.5) / n)
