"""Catalog, work list and serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, serving, worklist
from ..sources.tables import table
from .registry import query
from .views import PRICE_ORDER_SQL, price_order, view, with_views

AS_OF = "1998-06-01"
DAY = "1998-06-01"
PLATFORMS = ("1-URGENT", "3-MEDIUM")
SEEN_SQL = "SELECT p_partkey AS id, concat('part_', CAST(p_partkey AS VARCHAR)) AS alias FROM part WHERE p_partkey % 4 <> 1"
LATEST_SQL = f"SELECT record_id, price, date_created FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY {PRICE_ORDER_SQL}) AS k FROM prices) WHERE k = 1"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def seen(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_partkey % 4 <> 1")
    return parts.select(F.col("p_partkey").alias("id"), F.concat(F.lit("part_"), F.col("p_partkey")).alias("alias"))


def served(spark, sf_dir):
    return serving.records(*(view(spark, sf_dir, n) for n in ("records", "sessions", "details", "sellers", "prices")), price_order())


SERVED_SQL = f"""
SELECT r.id, r.make, r.model, r.year, r.mileage, r.link, s.domain, s.locale, d.seller_id, e.name AS seller_name, d.year AS d_year, d.mileage AS d_mileage,
       d.fuel_type AS d_fuel_type, d.transmission AS d_transmission, l.price, l.date_created AS price_date, r.date_created
FROM records r JOIN sessions s ON r.session_id = s.id JOIN details d ON d.record_id = r.id
LEFT JOIN sellers e ON e.id = d.seller_id LEFT JOIN ({LATEST_SQL}) l ON l.record_id = r.id
WHERE r.date_sold IS NULL AND l.record_id IS NOT NULL"""


@query(with_views(f"SELECT id, make, model, domain, locale, seller_name, price, strftime(price_date, '%Y-%m-%d') AS price_date FROM ({SERVED_SQL}) ORDER BY id"))
def latest_price_records(spark, sf_dir):
    """Unsold records with their latest price: the flagship."""
    return served(spark, sf_dir).select("id", "make", "model", "domain", "locale", "seller_name", "price", day("price_date")).orderBy("id")


@query(with_views("SELECT r.id, r.alias, p.price, strftime(p.date_created, '%Y-%m-%d') AS date FROM records r LEFT JOIN prices p ON p.record_id = r.id WHERE r.date_sold IS NULL"))
def prices_all(spark, sf_dir):
    return serving.prices(view(spark, sf_dir, "records"), view(spark, sf_dir, "prices"), None, price_order()).drop("date_created")


@query(
    with_views(
        f"""SELECT r.id, r.alias, p.price, strftime(p.date_created, '%Y-%m-%d') AS date FROM records r JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY {PRICE_ORDER_SQL}) AS k
        FROM prices WHERE date_created > TIMESTAMP '{DAY} 00:00:00' - INTERVAL 1 HOUR AND date_created < TIMESTAMP '{DAY} 23:59:59' - INTERVAL 1 HOUR) WHERE k = 1) p ON p.record_id = r.id WHERE r.date_sold IS NULL"""
    )
)
def prices_on_day(spark, sf_dir):
    """The last price of each record within a day; ship dates are at midnight, so the day begins an hour early."""
    prices = view(spark, sf_dir, "prices").withColumn("date_created", F.col("date_created") + F.expr("INTERVAL 1 HOUR"))
    return serving.prices(view(spark, sf_dir, "records"), prices, DAY, price_order()).drop("date_created").withColumn("date", F.lit(DAY))


@query(with_views(f"SELECT id, make, price FROM ({SERVED_SQL}) ORDER BY date_created, id LIMIT 100 OFFSET 200"))
def records_page(spark, sf_dir):
    return serving.page_of(served(spark, sf_dir), ["date_created", "id"], page=3).select("id", "make", "price")


@query("SELECT p_brand AS label, k AS item_rank, p_partkey AS item FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) WHERE k BETWEEN 11 AND 20")
def cached_page_slice(spark, sf_dir):
    """The second page of ten from each brand's cached list."""
    lists = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label")).agg(F.sort_array(F.collect_list("p_partkey")).alias("data"))
    return serving.cached_slice(lists, 2, 10).select("label", F.posexplode("data").alias("k", "item")).select("label", (F.col("k") + 11).alias("item_rank"), "item")


@query(with_views("SELECT count(*) AS n, CAST(ceil(count(*) / 100.0) AS BIGINT) AS pages FROM records WHERE date_sold IS NULL"))
def record_page_count(spark, sf_dir):
    return serving.page_count(view(spark, sf_dir, "records").where("date_sold IS NULL"))


@query(with_views(f"SELECT count(DISTINCT record_id) AS n, CAST(ceil(count(DISTINCT record_id) / 100.0) AS BIGINT) AS pages FROM prices WHERE date_created >= TIMESTAMP '{DAY} 00:00:00'"))
def price_page_count(spark, sf_dir):
    return serving.page_count(view(spark, sf_dir, "prices").where(F.col("date_created") >= as_of()), distinct="record_id")


@query(
    with_views(
        f"""SELECT id, make, CASE WHEN year = 0 THEN d_year ELSE year END AS year, CASE WHEN mileage = 0 THEN d_mileage ELSE mileage END AS mileage, d_fuel_type AS fuel_type, d_transmission AS transmission,
        domain, link, seller_id, seller_name, price, strftime(price_date, '%Y-%m-%d') AS price_date FROM ({SERVED_SQL})"""
    )
)
def record_nested(spark, sf_dir):
    """The served structs, flattened again for comparison."""
    n = serving.nested(served(spark, sf_dir))
    return n.select("id", "vehicle.make", "vehicle.year", "vehicle.mileage", "vehicle.fuel_type", "vehicle.transmission", "source.domain", "source.link", F.col("seller.id").alias("seller_id"), F.col("seller.name").alias("seller_name"), "price.price", F.col("price.date").alias("price_date"))


PENDING_SQL = "SELECT r.id, r.link, s.domain, s.locale, r.date_created FROM records r JOIN sessions s ON r.session_id = s.id WHERE r.date_sold IS NULL AND r.link IS NOT NULL AND NOT EXISTS (SELECT 1 FROM details d WHERE d.record_id = r.id)"
RECENT = f"date_created > TIMESTAMP '{AS_OF} 00:00:00' - INTERVAL 900 DAY"
OLD = f"date_created <= TIMESTAMP '{AS_OF} 00:00:00' - INTERVAL 900 DAY"
QUEUE = "id, link, domain, locale, strftime(date_created, '%Y-%m-%d') AS date_created"
IN_PLATFORMS = f"domain IN {PLATFORMS}"
BLANK_SQL = "SELECT r.id, r.link, s.domain, s.locale, r.date_created FROM records r JOIN sessions s ON r.session_id = s.id JOIN details d ON d.record_id = r.id WHERE r.date_sold IS NULL AND r.link IS NOT NULL AND d.registration_number IS NULL AND d.vin_number IS NULL AND d.sdk IS NULL"
DAYS = 900


def _queues(spark, sf_dir):
    own = [view(spark, sf_dir, n) for n in ("records", "sessions", "details")]
    return [
        worklist.priority(*own, as_of(), DAYS),
        worklist.inconclusive(*own),
        worklist.backlog(*own, as_of(), DAYS, PLATFORMS, of_platforms=True),
        worklist.backlog(*own, as_of(), DAYS, PLATFORMS, of_platforms=False),
    ]


@query(with_views(f"SELECT {QUEUE} FROM ({PENDING_SQL}) WHERE {RECENT}"))
def queue_priority(spark, sf_dir):
    return _queues(spark, sf_dir)[0].withColumn("date_created", day("date_created"))


@query(with_views(f"SELECT {QUEUE} FROM ({BLANK_SQL})"))
def queue_inconclusive(spark, sf_dir):
    return _queues(spark, sf_dir)[1].withColumn("date_created", day("date_created"))


@query(with_views(f"SELECT {QUEUE} FROM ({PENDING_SQL}) WHERE {OLD} AND {IN_PLATFORMS}"))
def queue_backlog_platform(spark, sf_dir):
    return _queues(spark, sf_dir)[2].withColumn("date_created", day("date_created"))


@query(with_views(f"SELECT {QUEUE} FROM ({PENDING_SQL}) WHERE {OLD} AND NOT {IN_PLATFORMS}"))
def queue_backlog_other(spark, sf_dir):
    return _queues(spark, sf_dir)[3].withColumn("date_created", day("date_created"))


@query(
    with_views(
        f"""SELECT 0 AS queue, {QUEUE} FROM ({PENDING_SQL}) WHERE {RECENT} UNION ALL SELECT 1, {QUEUE} FROM ({BLANK_SQL})
        UNION ALL SELECT 2, {QUEUE} FROM ({PENDING_SQL}) WHERE {OLD} AND {IN_PLATFORMS} UNION ALL SELECT 3, {QUEUE} FROM ({PENDING_SQL}) WHERE {OLD} AND NOT {IN_PLATFORMS}"""
    )
)
def queue_all_ordered(spark, sf_dir):
    return worklist.queued(_queues(spark, sf_dir)).withColumn("date_created", day("date_created"))


@query(with_views(f"SELECT domain, count(*) AS n, min(id) AS first_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY date_created, id) AS ids FROM ({PENDING_SQL}) GROUP BY domain"))
def work_by_domain(spark, sf_dir):
    own = [view(spark, sf_dir, n) for n in ("records", "sessions", "details")]
    rows = worklist.queued([worklist.priority(*own, as_of(), DAYS), worklist.backlog(*own, as_of(), DAYS)])
    lists = worklist.by_domain(rows, ["date_created", "id"])
    return lists.select("domain", F.size("items").alias("n"), F.array_min(F.col("items.id")).alias("first_id"), F.concat_ws(",", F.transform("items.id", lambda x: x.cast("string"))).alias("ids"))


@query("SELECT o_orderkey AS id, rn AS position, least(CAST(floor(rn / 200) AS BIGINT) * 8 + (rn % 200) % 8, CAST(ceil(n / 25.0) AS BIGINT) - 1) AS batch FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders)")
def batch_assignment(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    return worklist.batches(rows, ["o_orderdate", "id"], batch_size=25, pool_size=8).select("id", "position", "batch")


@query("SELECT o_orderkey AS id, o_orderpriority AS domain, round((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 0.5) / count(*) OVER (PARTITION BY o_orderpriority), 9) AS turn FROM orders")
def interleave_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"))
    return worklist.fair_order(rows, ["id"]).withColumn("turn", F.round("turn", 9))


@query()
def interleave_domains(spark, sf_dir):
    """The exact fair order of one page for each locale of a domain."""
    sizes = {r.o_orderpriority: r.n for r in table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.countDistinct("o_orderstatus").alias("n")).orderBy("o_orderpriority").collect()}
    return spark.createDataFrame(list(enumerate(worklist.interleave(sizes))), "place int, item string")


@query("SELECT o_orderpriority AS domain, locale, CAST((row_number() OVER (ORDER BY o_orderpriority, locale) - 1 + 7) % 4 AS INT) AS proxy FROM (SELECT DISTINCT o_orderpriority, o_orderstatus AS locale FROM orders)")
def expand_locales(spark, sf_dir):
    domains = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("domain")).agg(F.sort_array(F.collect_set("o_orderstatus")).alias("locales"))
    return worklist.expand_locales(domains, run_id=7, proxies=4)


ON_PAGE = "EXISTS (SELECT 1 FROM sessions s WHERE s.id = r.session_id AND s.url = 'https://1.example.com/F/')"


@query(with_views(f"SELECT id, CASE WHEN date_sold IS NULL AND {ON_PAGE} AND NOT EXISTS (SELECT 1 FROM ({SEEN_SQL}) n WHERE n.id = r.id) THEN '1998-05-31' ELSE strftime(date_sold, '%Y-%m-%d') END AS date_sold FROM records r"))
def sold_records(spark, sf_dir):
    out = catalog.mark_sold(view(spark, sf_dir, "records"), view(spark, sf_dir, "sessions"), seen(spark, sf_dir), "https://1.example.com/F/", as_of())
    return out.select("id", day("date_sold"))


@query(with_views(f"SELECT id, CASE WHEN date_sold IS NOT NULL AND {ON_PAGE} AND EXISTS (SELECT 1 FROM ({SEEN_SQL}) n WHERE n.id = r.id) THEN NULL ELSE strftime(date_sold, '%Y-%m-%d') END AS date_sold FROM records r"))
def reappeared_records(spark, sf_dir):
    out = catalog.mark_reappeared(view(spark, sf_dir, "records"), view(spark, sf_dir, "sessions"), seen(spark, sf_dir), "https://1.example.com/F/")
    return out.select("id", day("date_sold"))


@query(with_views("SELECT n.alias, r.id, r.id IS NOT NULL AS existing FROM (SELECT concat('part_', CAST(p_partkey * 2 AS VARCHAR)) AS alias FROM part) n LEFT JOIN records r ON r.alias = n.alias"))
def new_vs_existing(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("part_"), F.col("p_partkey") * 2).alias("alias"))
    return catalog.split_known(rows, view(spark, sf_dir, "records")).select("alias", "id", "existing")


@query(
    with_views(
        """SELECT coalesce(d.record_id, n.record_id) AS record_id, CASE WHEN d.record_id IS NOT NULL THEN d.seller_id ELSE n.seller_id END AS seller_id,
        CASE WHEN n.record_id IS NOT NULL THEN n.mileage ELSE d.mileage END AS mileage, CASE WHEN n.record_id IS NOT NULL THEN n.fuel_type ELSE d.fuel_type END AS fuel_type, d.transmission
        FROM details d FULL OUTER JOIN (SELECT p_partkey AS record_id, 99 AS seller_id, p_size AS mileage, CAST(NULL AS VARCHAR) AS fuel_type FROM part WHERE p_partkey % 2 = 0) n ON n.record_id = d.record_id"""
    )
)
def upsert_details(spark, sf_dir):
    changes = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").selectExpr("p_partkey AS record_id", "99 AS seller_id", "p_size AS mileage", "CAST(NULL AS STRING) AS fuel_type")
    return catalog.upsert_details(view(spark, sf_dir, "details"), changes).select("record_id", "seller_id", "mileage", "fuel_type", "transmission")


@query(with_views("SELECT id, CASE WHEN image_link IS NULL AND id % 2 = 0 THEN concat('new/', CAST(id AS VARCHAR)) ELSE image_link END AS image_link FROM records"))
def fill_missing_image(spark, sf_dir):
    records = view(spark, sf_dir, "records").withColumn("image_hash", F.lit(None).cast("string"))
    fresh = records.where("id % 2 = 0").select("id", F.concat(F.lit("new/"), F.col("id")).alias("image_link"), F.lit("h").alias("image_hash"))
    return catalog.fill_images(records, fresh).select("id", "image_link")


@query(with_views(f"SELECT record_id, round(price, 2) AS price, session_id, strftime(date_created, '%Y-%m-%d') AS date FROM prices UNION ALL SELECT r.id, r.id * 1.0, 777, '{AS_OF}' FROM ({SEEN_SQL}) n JOIN records r ON r.alias = n.alias"))
def price_append(spark, sf_dir):
    rows = seen(spark, sf_dir).select("alias", F.col("id").cast("double").alias("price"))
    out = catalog.append_prices(view(spark, sf_dir, "prices"), rows, view(spark, sf_dir, "records").select("id", "alias"), F.lit(777).cast("bigint"), as_of())
    return out.select("record_id", F.round("price", 2).alias("price"), "session_id", F.date_format("date_created", "yyyy-MM-dd").alias("date"))


@query(with_views("SELECT record_id, count(*) AS changes FROM (SELECT record_id, price, lag(price) OVER (PARTITION BY record_id ORDER BY date_created, session_id, line, price) AS b FROM prices) WHERE b IS NULL OR price <> b GROUP BY record_id"))
def price_changes(spark, sf_dir):
    return catalog.price_changes(view(spark, sf_dir, "prices"), ["date_created", "session_id", "line", "price"]).groupBy("record_id").agg(F.count("*").alias("changes"))


@query(with_views("SELECT id, CAST(date_diff('day', start_time, start_time + INTERVAL 3 DAY) AS BIGINT) AS days FROM sessions"))
def run_durations(spark, sf_dir):
    runs = view(spark, sf_dir, "sessions").select("id", "start_time")
    ended = runs.select("id", (F.col("start_time") + F.expr("INTERVAL 3 DAYS")).alias("end_time"))
    return catalog.end_runs(runs, ended).select("id", F.expr("extract(DAY FROM duration)").cast("bigint").alias("days"))


AVERAGE_SQL = "SELECT url, CAST(trunc(avg(found_count)) AS INT) AS average FROM history WHERE found_count > 5 AND end_time > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND end_time < TIMESTAMP '2024-01-20' - INTERVAL 1 DAY GROUP BY url"


def _averages(spark, sf_dir):
    return catalog.average_found(view(spark, sf_dir, "history"), ["url"], 5, F.lit("2024-01-20").cast("timestamp"))


@query(with_views(AVERAGE_SQL))
def avg_found_count(spark, sf_dir):
    return _averages(spark, sf_dir)


@query(with_views(f"SELECT h.url, round(h.found_count, 2) AS found_count, a.average, coalesce(abs(a.average - h.found_count) > a.average * 0.5, false) AS drifted FROM history h LEFT JOIN ({AVERAGE_SQL}) a ON a.url = h.url WHERE h.end_time >= TIMESTAMP '2024-01-20'"))
def count_drift(spark, sf_dir):
    now = view(spark, sf_dir, "history").where("end_time >= TIMESTAMP '2024-01-20'")
    return catalog.count_drift(now, _averages(spark, sf_dir), ["url"], 0.5).select("url", F.round("found_count", 2).alias("found_count"), "average", "drifted")


CACHE_SQL = "SELECT event_id AS id, event_type AS cache_type, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS date, props AS data FROM events"


def _cache(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("cache_type"), F.when(F.col("event_id") % 50 != 0, F.to_date("ts")).alias("date"), F.col("props").alias("data"))


@query(f"SELECT id, cache_type, CAST(date AS VARCHAR) AS date FROM ({CACHE_SQL}) WHERE date IS NULL OR date >= DATE '2024-01-30' - 10")
def cache_ttl(spark, sf_dir):
    return serving.fresh(_cache(spark, sf_dir), F.lit("2024-01-30").cast("date"), 10).select("id", "cache_type", F.col("date").cast("string").alias("date"))


@query(f"SELECT cache_type, id, data FROM (SELECT *, row_number() OVER (PARTITION BY cache_type ORDER BY date DESC NULLS FIRST, id DESC) AS k FROM ({CACHE_SQL})) WHERE k = 1")
def cache_latest(spark, sf_dir):
    return serving.latest_cached(_cache(spark, sf_dir), ["cache_type"], [F.desc("id")]).select("cache_type", "id", "data")


@query(f"SELECT cache_type, count(*) AS n, count(DISTINCT data) AS kinds FROM (SELECT cache_type, data FROM ({CACHE_SQL}) c WHERE date IS NULL OR NOT (date = DATE '2024-01-05' AND cache_type = 'view') UNION ALL SELECT 'view', 'new') GROUP BY cache_type")
def cache_put(spark, sf_dir):
    new = spark.range(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit("view").alias("cache_type"), F.lit("2024-01-05").cast("date").alias("date"), F.lit("new").alias("data"))
    return serving.put_cached(_cache(spark, sf_dir), new).groupBy("cache_type").agg(F.count("*").alias("n"), F.countDistinct("data").alias("kinds"))


@query("SELECT source AS alias, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_first_alias(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("alias"))
    return catalog.first_by_alias(docs, ["doc_id"]).select("alias", "doc_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def new_only(spark, sf_dir):
    return catalog.new_only(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query(with_views("SELECT s.id, s.url, coalesce(c.n, 0) AS found_count FROM sessions s LEFT JOIN (SELECT session_id, count(*) AS n FROM records GROUP BY session_id) c ON c.session_id = s.id"))
def session_counts(spark, sf_dir):
    found = view(spark, sf_dir, "records").select(F.col("session_id").alias("page_id"))
    return catalog.insert_sessions(view(spark, sf_dir, "sessions").select("id", "url"), found)


@query(with_views("SELECT record_id, fuel_type, transmission, registration_number, n_empty, CASE WHEN n_empty <= 1 THEN 'ok' WHEN registration_number <> '' THEN 'partial' ELSE 'failed' END AS status FROM (SELECT *, (CASE WHEN coalesce(fuel_type, '') = '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(transmission, '') = '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(registration_number, '') = '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(vin_number, '') = '' THEN 1 ELSE 0 END) AS n_empty FROM details)"))
def empty_fields(spark, sf_dir):
    fields = ["fuel_type", "transmission", "registration_number", "vin_number"]
    return catalog.detail_status(view(spark, sf_dir, "details"), fields, 1, ["registration_number"]).select("record_id", *fields[:3], "n_empty", "status")


@query(with_views("SELECT record_id, coalesce(nullif(fuel_type, ''), 'diesel') AS fuel_type, coalesce(nullif(transmission, ''), 'auto') AS transmission FROM details"))
def fuzzy_fill(spark, sf_dir):
    details = view(spark, sf_dir, "details").select("record_id", "fuel_type", "transmission")
    whole = details.select("record_id", F.lit("diesel").alias("fuel_type"), F.lit("auto").alias("transmission"))
    return catalog.fuzzy_fill(details, whole, "record_id")


@query(with_views("SELECT r.id FROM records r JOIN sessions s ON s.id = r.session_id WHERE r.image_link IS NOT NULL AND s.domain = '2-HIGH' AND s.locale = 'F' AND r.link IS NOT NULL"))
def records_with_images(spark, sf_dir):
    from ..sources.tables import records_with_images as found

    return found(view(spark, sf_dir, "records"), view(spark, sf_dir, "sessions"), "2-HIGH", "F", ("link",)).select("id")


@query(
    with_views(
        """SELECT r.id, r.alias, CASE WHEN s.id IS NULL THEN strftime(r.date_sold, '%Y-%m-%d') WHEN r.date_sold IS NOT NULL AND n.alias IS NOT NULL THEN NULL
        WHEN r.date_sold IS NULL AND n.alias IS NULL THEN '1998-05-31' ELSE strftime(r.date_sold, '%Y-%m-%d') END AS date_sold, coalesce(p.n, 0) + (CASE WHEN n.alias IS NULL THEN 0 ELSE 1 END) AS prices
        FROM records r LEFT JOIN (SELECT id FROM sessions WHERE url = 'https://1.example.com/F/') s ON s.id = r.session_id LEFT JOIN (SELECT concat('part_', CAST(p_partkey AS VARCHAR)) AS alias FROM part WHERE p_partkey % 4 <> 1) n ON n.alias = r.alias
        LEFT JOIN (SELECT record_id, count(*) AS n FROM prices GROUP BY record_id) p ON p.record_id = r.id
        UNION ALL SELECT 1 + (SELECT max(p_partkey) FROM part), 'part_new', NULL, 1"""
    )
)
def save_page(spark, sf_dir):
    """One page's records saved: new, stored, sold and reappeared ones, and their numbers of prices."""
    parts = table(spark, sf_dir, "part")
    rows = parts.where("p_partkey % 4 <> 1").select(F.col("p_partkey").cast("string").alias("alias"), F.col("p_partkey").alias("pos"))
    rows = rows.unionByName(spark.range(1).select(F.lit("new").alias("alias"), F.lit(-1).cast("long").alias("pos")))
    rows = rows.withColumns({"price": F.lit(1.0), "image_link": F.lit(None).cast("string"), "image_hash": F.lit(None).cast("string")})
    records = view(spark, sf_dir, "records").withColumn("image_hash", F.lit(None).cast("string"))
    out, prices = catalog.save(records, view(spark, sf_dir, "prices"), view(spark, sf_dir, "sessions"), rows, "part", "https://1.example.com/F/", 777, as_of())
    counts = prices.groupBy(F.col("record_id").alias("id")).agg(F.count("*").alias("prices"))
    return out.join(counts, "id", "left").select("id", "alias", day("date_sold"), F.coalesce("prices", F.lit(0)).alias("prices"))


@query(f"SELECT cache_type, id FROM ({CACHE_SQL}) WHERE date IS NULL OR date >= DATE '2024-01-30' - 10 UNION ALL SELECT 'ALL', 0")
def cache_refreshed(spark, sf_dir):
    from ..operators import api

    cache = _cache(spark, sf_dir)
    new = spark.range(1).select(F.lit(0).cast("long").alias("id"), F.lit("ALL").alias("cache_type"), F.lit(None).cast("date").alias("date"), F.lit("x").alias("data"))
    return api.refreshed(cache, new, F.lit("2024-01-30").cast("date"), 10).select("cache_type", "id")


@query(with_views(f"SELECT session_id, count(*) FILTER (WHERE alias NOT IN (SELECT alias FROM ({SEEN_SQL}))) AS n FROM records GROUP BY session_id"))
def new_block_counts(spark, sf_dir):
    """How many blocks of each page are new."""
    return catalog.new_counts(view(spark, sf_dir, "records"), seen(spark, sf_dir), "session_id")


@query(
    with_views(
        f"""SELECT r.alias, r.title, r.make, r.model, NULL AS variant, r.year, r.mileage, concat(s.url, substr(r.link, 2)) AS link, r.session_id, NULL AS sharepoint_link, NULL AS image_hash, NULL AS fuel_type, NULL AS transmission
        FROM (SELECT *, CASE WHEN link IS NULL THEN 0 ELSE 1 END AS has FROM records) r JOIN sessions s ON s.id = r.session_id WHERE r.has = 1 AND NOT (r.image_link IS NOT NULL AND r.alias IN (SELECT alias FROM ({SEEN_SQL})))"""
    )
)
def formatted_records(spark, sf_dir):
    """Records with a link in the thirteen columns that are stored."""
    records = view(spark, sf_dir, "records")
    rows = records.where("link IS NOT NULL").join(view(spark, sf_dir, "sessions").select(F.col("id").alias("session_id"), "url"), "session_id")
    return catalog.formatted(rows, ["id"], F.col("url"), seen(spark, sf_dir), records.where("image_link IS NOT NULL"))
