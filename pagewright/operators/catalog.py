"""Incremental catalog maintenance as state in, state out.

Tables are DataFrames; an update returns the new table.  ``as_of`` stands for the
current time, so that runs can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def start_runs(runs: DataFrame, started: DataFrame) -> DataFrame:
    """Runs and those that start; ids come from the caller."""
    return runs.unionByName(started, allowMissingColumns=True)


def end_runs(runs: DataFrame, ended: DataFrame) -> DataFrame:
    """``ended`` (id, end_time) closes runs; duration is end minus start."""
    ended = ended.select("id", F.col("end_time").alias("_end"))
    out = runs.join(ended, "id", "left").withColumn("end_time", F.coalesce("_end", "end_time") if "end_time" in runs.columns else F.col("_end")).drop("_end")
    return out.withColumn("duration", F.col("end_time") - F.col("start_time"))


def insert_sessions(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Each scraped page (id) with its number of found records (page_id)."""
    counts = found.groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias("found_count"))
    return pages.join(counts, "id", "left").withColumn("found_count", F.coalesce("found_count", F.lit(0)))


def session_fields(sessions: DataFrame, rows: DataFrame, fields: Sequence[str], unavailable: Sequence[str] = ()) -> DataFrame:
    """Detail sessions (id): found_count is how many fields their record (session_id) has."""
    from ..functions.scalars import empty_fields

    wanted = [f for f in fields if f not in unavailable]
    filled = rows.groupBy(F.col("session_id").alias("id")).agg(F.max(F.lit(len(wanted)) - empty_fields(wanted)).alias("found_count"))
    return update(sessions, filled, "id", ["found_count"])


def update(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of ``table`` with the columns of matching ``changes``, also where those are null."""
    changes = changes.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = table.join(changes, key, "left")
    return out.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def first_by_alias(rows: DataFrame, order: Sequence[Column | str], key: str = "alias") -> DataFrame:
    """One row for each alias, the first; null is one alias."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def new_only(rows: DataFrame, known: DataFrame, key: str = "alias") -> DataFrame:
    """Rows whose alias isn't known; a null alias is known if a null one is."""
    known = known.select(F.col(key).alias("_known")).distinct()
    return rows.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")


def with_ids(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Rows with the id of their alias; an alias of several records has none."""
    ids = records.groupBy("alias").agg(F.min("id").alias("id"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return rows.join(ids, "alias", "left")


def split_known(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Rows with ``existing``: whether their alias is stored."""
    return with_ids(rows, records).withColumn("existing", F.col("id").isNotNull())


def append_new(records: DataFrame, rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Records and the first row of each alias that isn't stored; other columns are null."""
    fresh = new_only(first_by_alias(rows.where("alias <> ''"), order), records)
    return records.unionByName(fresh, allowMissingColumns=True)


def save(records: DataFrame, prices: DataFrame, sessions: DataFrame, seen: DataFrame, domain: str, url: str, session_id: int, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """A page's records put into the catalog: records and prices after it.

    ``seen`` has alias, price, image_link, image_hash and any columns of records, in
    the order of ``pos``.  Aliases get the domain in front; the first row of each
    counts.  New ones get the next ids, stored ones an image if they had none; all
    get a price.  Sold ones that were seen are unsold, unsold ones of the page that
    weren't are sold.
    """
    from ..functions.links import namespaced
    from .numbering import numbered

    rows = first_by_alias(seen.withColumn("alias", namespaced(F.col("alias"), F.lit(domain))).where("alias IS NOT NULL"), ["pos"])
    top = records.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh, _ = numbered(new_only(rows, records), ["pos", "alias"])
    fresh = fresh.withColumns({"id": F.col("position") + top + 1, "session_id": F.lit(session_id).cast("long"), "date_created": as_of, "date_sold": F.lit(None).cast("timestamp")})
    known = [c for c in records.columns if c in fresh.columns]
    stored = with_ids(rows, records).where("id IS NOT NULL").select("id", "image_link", "image_hash")
    out = fill_images(records, stored).unionByName(fresh.select(*known), allowMissingColumns=True)
    ids = with_ids(rows.select("alias"), out).select("id")
    out = mark_sold(mark_reappeared(out, sessions, ids, url), sessions, ids, url, as_of)
    return out, append_prices(prices, rows.select("alias", "price"), out.select("id", "alias"), F.lit(session_id).cast("long"), as_of)


#: The columns of a stored record, in their order.
STORED = ("alias", "title", "make", "model", "variant", "year", "mileage", "link", "session_id", "sharepoint_link", "image_hash", "fuel_type", "transmission")


def formatted(rows: DataFrame, order: Sequence[Column | str], url: Column, stored: DataFrame, with_images: DataFrame) -> DataFrame:
    """Found records as they are stored: the first row of each alias, links made whole, what wasn't found null.

    Those that are stored already (``stored``, by alias) and have an image
    (``with_images``) are left out.
    """
    from ..functions.links import format_link

    done = stored.select("alias").join(with_images.select("alias"), "alias", "left_semi")
    rows = new_only(first_by_alias(rows.withColumn("link", format_link(F.col("link"), url)), order), done)
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in STORED))


def new_counts(rows: DataFrame, known: DataFrame, by: str, key: str = "alias") -> DataFrame:
    """For each page (``by``) the number of its rows whose alias isn't known."""
    fresh = new_only(rows, known, key).groupBy(by).agg(F.count("*").alias("n"))
    return rows.select(by).distinct().join(fresh, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))


def page_status(sessions: DataFrame, least: int) -> DataFrame:
    """``result`` of each page: too few records asks for another try."""
    return sessions.withColumn("result", F.when(F.col("found_count") < least, "too few records").otherwise("ok"))


def fill_images(records: DataFrame, seen: DataFrame) -> DataFrame:
    """Image link and hash of seen rows, for records that have no image yet."""
    seen = seen.where("image_link IS NOT NULL").groupBy("id").agg(F.min(F.struct("image_link", "image_hash")).alias("_i"))
    bare = F.col("image_link").isNull() & F.col("_i").isNotNull()
    out = records.join(seen, "id", "left")
    return out.withColumns({"image_hash": F.when(bare, F.col("_i.image_hash")).otherwise(F.col("image_hash")), "image_link": F.when(bare, F.col("_i.image_link")).otherwise(F.col("image_link"))}).select(*records.columns)


def append_prices(prices: DataFrame, seen: DataFrame, records: DataFrame, session_id: Column, as_of: Column) -> DataFrame:
    """One more price for each seen record, changed or not; rows without a stored alias add none."""
    rows = with_ids(seen, records).where("id IS NOT NULL")
    return prices.unionByName(rows.select(F.col("id").alias("record_id"), "price", session_id.alias("session_id"), as_of.alias("date_created")), allowMissingColumns=True)


def price_changes(prices: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The price log without repeats: rows whose price differs from the one before."""
    before = F.lag("price").over(Window.partitionBy("record_id").orderBy(*order))
    return prices.withColumn("_b", before).where(~F.col("price").eqNullSafe(F.col("_b")) | F.col("_b").isNull()).drop("_b")


def upsert_details(details: DataFrame, changes: DataFrame) -> DataFrame:
    """By record_id: new details are inserted, stored ones take every column but id and seller_id."""
    kept = {"record_id", "id", "seller_id"}
    old, new = details.alias("o"), changes.withColumn("_hit", F.lit(True)).alias("n")
    both = old.join(new, F.col("o.record_id") == F.col("n.record_id"), "full_outer")

    def column(c: str) -> Column:
        if c not in changes.columns:
            return F.col(f"o.{c}")
        if c in kept:
            return F.when(F.col("o.record_id").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        return F.when(F.col("n._hit"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*(column(c).alias(c) for c in details.columns))


def _on_page(records: DataFrame, sessions: DataFrame, url: Column | str) -> DataFrame:
    sessions = sessions.where(F.col("url") == url).select(F.col("id").alias("session_id"))
    return records.join(sessions, "session_id", "left_semi").select("id")


def mark_sold(records: DataFrame, sessions: DataFrame, seen: DataFrame, url: Column | str, as_of: Column) -> DataFrame:
    """Unsold records of a page that weren't seen are sold, a day before ``as_of``; nothing if none was seen."""
    seen_ids = seen.select("id").where("id IS NOT NULL").distinct()
    gone = _on_page(records.where("date_sold IS NULL"), sessions, url).join(seen_ids, "id", "left_anti")
    gone = gone.join(F.broadcast(seen_ids.limit(1).select(F.lit(1).alias("_some"))), F.lit(1) == F.col("_some"), "left_semi")
    return update(records, gone.select("id", (as_of - F.expr("INTERVAL 1 DAY")).alias("date_sold")), "id", ["date_sold"])


def mark_reappeared(records: DataFrame, sessions: DataFrame, seen: DataFrame, url: Column | str) -> DataFrame:
    """Sold records of a page that were seen again are unsold."""
    back = _on_page(records.where("date_sold IS NOT NULL"), sessions, url).join(seen.select("id").distinct(), "id", "left_semi")
    return update(records, back.select("id", F.lit(None).cast(records.schema["date_sold"].dataType).alias("date_sold")), "id", ["date_sold"])


def average_found(history: DataFrame, keys: Sequence[str], warning: float, as_of: Column) -> DataFrame:
    """The whole part of the mean found_count by page, over counts above the warning and runs that ended
    strictly between seven days and one day before ``as_of``."""
    recent = history.where((F.col("found_count") > warning) & (F.col("end_time") > as_of - F.expr("INTERVAL 7 DAYS")) & (F.col("end_time") < as_of - F.expr("INTERVAL 1 DAY")))
    return recent.groupBy(*keys).agg(F.avg("found_count").cast("int").alias("average"))


def count_drift(current: DataFrame, averages: DataFrame, keys: Sequence[str], difference: float) -> DataFrame:
    """Pages with ``drifted``: their count is further from the average than this share of it; without an average not."""
    out = current.join(averages, list(keys), "left")
    return out.withColumn("drifted", F.coalesce(F.abs(F.col("average") - F.col("found_count")) > F.col("average") * difference, F.lit(False)))


def drop_default_images(images: DataFrame, defaults: DataFrame) -> DataFrame:
    """Images whose hash isn't that of a default image (a short list)."""
    defaults = defaults.select(F.col("hash").alias("image_hash")).distinct()
    return images.where("image_hash IS NOT NULL").join(defaults, "image_hash", "left_anti")


def fuzzy_fill(first: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Null or empty fields of a record take those of the record read from the whole page."""
    fields = [c for c in first.columns if c != key]
    other = whole.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    filled = {c: F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    return first.join(other, key, "left").select(key, *(filled[c].alias(c) for c in fields))


def detail_status(rows: DataFrame, fields: Sequence[str], threshold: int, important: Sequence[str]) -> DataFrame:
    """``status``: ok with few empty fields, partial if an important one is there, else failed."""
    from ..functions.scalars import empty_fields

    empty = empty_fields(fields)
    some = empty_fields(important) < len(important)
    return rows.withColumns({"n_empty": empty, "status": F.when(empty <= threshold, "ok").when(some, "partial").otherwise("failed")})
