"""Catalog, work list and serving operators on the edge rows that they must get right."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagewright.operators import catalog, serving, worklist
from pagewright.operators.numbering import numbered


def T(s):
    return dt.datetime.fromisoformat(s)


def now():
    return F.lit("2024-05-17 12:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (1, "d_a", 10, "/a", None, T("2024-05-16"), None),
        (2, "d_b", 10, "/b", "i", T("2024-05-01"), None),
        (3, "d_c", 10, None, None, T("2024-05-16"), T("2024-05-10")),
        (4, "d_d", 11, "/d", None, T("2024-05-16"), None),
        (5, "d_b", 11, "/e", None, T("2024-05-01"), None),
    ]
    return spark.createDataFrame(rows, "id long, alias string, session_id long, link string, image_link string, date_created timestamp, date_sold timestamp").withColumn("image_hash", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame([(10, "x", "de", "http://u", 1), (11, "y", "en", "http://v", 1)], "id long, domain string, locale string, url string, run_id long")


def sold(df):
    return {r.id: r.date_sold for r in df.collect()}


def test_sold_and_reappeared(spark, records, sessions):
    seen = spark.createDataFrame([(2,), (3,), (None,)], "id long")
    assert sold(catalog.mark_sold(records, sessions, seen, "http://u", now())) == {1: T("2024-05-16T12:00"), 2: None, 3: T("2024-05-10"), 4: None, 5: None}
    assert sold(catalog.mark_sold(records, sessions, seen.where("id is null"), "http://u", now())) == sold(records)
    assert sold(catalog.mark_reappeared(records, sessions, seen, "http://u")) == {1: None, 2: None, 3: None, 4: None, 5: None}


def test_aliases(spark, records):
    rows = spark.createDataFrame([("d_a", 1), ("d_b", 2), ("new", 4), ("new", 3), (None, 5), (None, 6), ("", 7)], "alias string, pos int")
    assert {(r.alias, r.pos) for r in catalog.first_by_alias(rows, ["pos"]).collect()} == {("d_a", 1), ("d_b", 2), ("new", 3), (None, 5), ("", 7)}
    assert {r.alias: r.id for r in catalog.split_known(rows.where("alias like 'd_%' or alias = 'new'"), records).collect()} == {"d_a": 1, "d_b": None, "new": None}
    assert {r.pos for r in catalog.new_only(rows, records).collect()} == {3, 4, 5, 6, 7}
    assert catalog.new_only(rows, rows.where("alias is null")).where("alias is null").count() == 0
    assert catalog.append_new(records, rows, ["pos"]).where("alias = 'new'").select("pos").collect()[0].pos == 3


def test_images_and_prices(spark, records):
    seen = spark.createDataFrame([(1, "n1", "h1"), (2, "n2", "h2"), (4, None, None)], "id long, image_link string, image_hash string")
    assert {r.id: (r.image_link, r.image_hash) for r in catalog.fill_images(records, seen).collect()} == {1: ("n1", "h1"), 2: ("i", None), 3: (None, None), 4: (None, None), 5: (None, None)}
    prices = spark.createDataFrame([(1, 5.0, 9, T("2024-01-01"))], "record_id long, price double, session_id long, date_created timestamp")
    rows = spark.createDataFrame([("d_a", 5.0), ("d_b", 6.0), ("none", 7.0)], "alias string, price double")
    out = catalog.append_prices(prices, rows, records, F.lit(12).cast("long"), now())
    assert [(r.record_id, r.price, r.session_id) for r in out.orderBy("date_created").collect()] == [(1, 5.0, 9), (1, 5.0, 12)]
    assert catalog.price_changes(out, ["date_created"]).count() == 1


def test_details(spark):
    old = spark.createDataFrame([(1, 10, 5, "a"), (2, 20, 6, "b")], "id long, record_id long, seller_id long, make string")
    new = spark.createDataFrame([(None, 20, 7, None), (3, 30, 8, "c")], "id long, record_id long, seller_id long, make string")
    assert {r.record_id: (r.id, r.seller_id, r.make) for r in catalog.upsert_details(old, new).collect()} == {10: (1, 5, "a"), 20: (2, 6, None), 30: (3, 8, "c")}
    filled = catalog.fuzzy_fill(spark.createDataFrame([(1, "", None, "x")], "k int, a string, b string, c string"), spark.createDataFrame([(1, "A", "B", "C")], "k int, a string, b string, c string"), "k")
    assert tuple(filled.first()) == (1, "A", "B", "x")
    status = catalog.detail_status(spark.createDataFrame([("a", "b", "c"), ("", "b", None), (None, None, "c")], "a string, b string, c string"), ["a", "b", "c"], 1, ["b"])
    assert [(r.n_empty, r.status) for r in status.collect()] == [(0, "ok"), (2, "partial"), (2, "failed")]


def test_runs_and_drift(spark):
    runs = spark.createDataFrame([(1, T("2024-01-01"), None), (2, T("2024-01-01"), None)], "id int, start_time timestamp, end_time timestamp")
    ended = catalog.end_runs(runs, spark.createDataFrame([(1, T("2024-01-01T02:30"))], "id int, end_time timestamp"))
    assert {r.id: r.duration for r in ended.collect()} == {1: dt.timedelta(hours=2, minutes=30), 2: None}
    history = spark.createDataFrame([("u", 10, T("2024-05-12")), ("u", 21, T("2024-05-13")), ("u", 3, T("2024-05-13")), ("u", 99, T("2024-05-10T12:00")), ("u", 99, T("2024-05-16T12:00"))], "url string, found_count int, end_time timestamp")
    average = catalog.average_found(history, ["url"], 5, now())
    assert average.collect()[0].average == 15
    current = spark.createDataFrame([("u", 7), ("u", 8), ("w", 1)], "url string, found_count int")
    assert [(r.found_count, r.drifted) for r in catalog.count_drift(current, average, ["url"], 0.5).orderBy("found_count").collect()] == [(1, False), (7, True), (8, False)]


def test_queues(spark, records, sessions):
    details = spark.createDataFrame([(2, None, None, None), (5, "r", None, None)], "record_id long, registration_number string, vin_number string, sdk string")
    got = [worklist.priority(records, sessions, details, now()), worklist.inconclusive(records, sessions, details), worklist.backlog(records, sessions, details.limit(0), now(), 2, ["x"]), worklist.backlog(records, sessions, details.limit(0), now(), 2, ["x"], of_platforms=False)]
    assert [sorted(r.id for r in q.collect()) for q in got] == [[1, 4], [2], [2], [5]]
    all_ = worklist.queued(got)
    assert sorted((r.queue, r.id) for r in all_.collect()) == [(0, 1), (0, 4), (1, 2), (2, 2), (3, 5)]
    assert {r.domain: [i.id for i in r["items"]] for r in worklist.by_domain(all_, ["queue", "id"]).collect()} == {"x": [1, 2, 2], "y": [4, 5]}


@pytest.mark.parametrize(("sizes", "want"), [({"a": 4, "b": 2}, "a1 b1 a2 b2 a3 a4"), ({"a": 3, "b": 3, "c": 1}, "a1 b1 c1 a2 b2 b3 a3"), ({"a": 5, "b": 1, "c": 1}, "a1 b1 a2 c1 a3 a4 a5"), ({"a": 2, "b": 2, "c": 2}, "a1 b1 c1 c2 b2 a2"), ({}, ""), ({"a": 1}, "a1")])
def test_interleave(sizes, want):
    assert " ".join(worklist.interleave(sizes)) == want


@pytest.mark.parametrize(("n", "b", "s", "want"), [(7, 2, 2, [[0, 2], [1, 3], [4, 6], [5]]), (10, 3, 2, [[0, 2, 4], [1, 3, 5], [6, 8], [7, 9]]), (9, 4, 2, [[0, 2, 4, 6], [1, 3, 5, 7], [8]])])
def test_batches(spark, n, b, s, want):
    got = {}
    for r in worklist.batches(spark.range(n), ["id"], b, s).orderBy("id").collect():
        got.setdefault(r.batch, []).append(r.id)
    assert [got[k] for k in sorted(got)] == want


def test_numbered(spark):
    rows, n = numbered(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")), ["k"])
    assert n == 1000 and [r.position for r in rows.orderBy("k").collect()] == list(range(1000))


def test_serving(spark, records, sessions):
    prices = spark.createDataFrame([(1, 5.0, T("2024-05-16T10:00"), 1), (1, 6.0, T("2024-05-16T10:00"), 2), (2, 7.0, T("2024-05-17T00:00"), 1), (2, 8.0, T("2024-05-17T23:59:59"), 1), (2, 9.0, T("2024-05-17T23:59:58"), 1)], "record_id long, price double, date_created timestamp, seq int")
    order = [F.desc("date_created"), F.desc("seq")]
    details = spark.createDataFrame([(1, 100, 2001, 5, "f", "t", T("2024-01-01")), (4, None, 2002, 6, "", None, T("2024-01-01"))], "record_id long, seller_id long, year int, mileage int, fuel_type string, transmission string, date_created timestamp")
    sellers = spark.createDataFrame([(100, "S")], "id long, name string")
    more = records.withColumns({"make": F.lit("m"), "model": F.lit("n"), "year": F.when(F.col("id") == 1, 0), "mileage": F.lit(3), "fuel_type": F.lit("own"), "transmission": F.lit("own")})
    got = serving.records(more, sessions, details, sellers, prices, order)
    assert [(r.id, r.price, r.seller_name) for r in got.collect()] == [(1, 6.0, "S")]  # without a price there is no record
    assert tuple(serving.nested(got.drop("fuel_type")).first().vehicle)[2:] == (2001, 3, "f", "t")
    all_ = serving.prices(records, prices, None, order)
    assert {(r.id, r.price) for r in all_.collect()} >= {(4, None), (1, 5.0), (1, 6.0)}
    assert [(r.id, r.price) for r in serving.prices(records, prices, "2024-05-17", order).collect()] == [(2, 9.0)]
    with pytest.raises(ValueError, match="start at 1"):
        serving.page_of(records, ["id"], 0)
    assert [r.id for r in serving.page_of(records, ["id"], 2, 2).collect()] == [3, 4]
    assert tuple(serving.page_count(records, 2).first()) == (5, 3) and tuple(serving.page_count(records, 2, "alias").first()) == (4, 2)
    assert serving.cache_key("records", "all") == "RECORDS_ALL"


def test_cache(spark, tmp_path):
    day = dt.date(2024, 5, 1)
    cache = spark.createDataFrame([(1, "A", None, "x"), (2, "A", day, "y"), (3, "B", dt.date(2024, 1, 1), "z")], "id int, cache_type string, date date, data string")
    assert {r.id for r in serving.fresh(cache, F.lit("2024-05-10").cast("date"), 9).collect()} == {1, 2}
    assert {r.cache_type: r.id for r in serving.latest_cached(cache, ["cache_type"], [F.desc("id")]).collect()} == {"A": 1, "B": 3}
    assert {r.data for r in serving.put_cached(cache, cache.where("id <= 2").withColumn("data", F.lit("new"))).collect()} == {"new", "z"}
    path = str(tmp_path / "cache")
    serving.write_cache(cache, path)
    serving.write_cache(cache.where("id = 2").withColumn("data", F.lit("newer")), path)
    assert {r.id: r.data for r in spark.read.parquet(path).collect()} == {1: "x", 2: "newer", 3: "z"}


def test_save(spark, records, sessions):
    prices = spark.createDataFrame([], "record_id long, price double, session_id long, date_created timestamp")
    rows = [("a", 1.0, 0, "i1"), ("a", 9.0, 1, "i9"), ("c", 2.0, 2, None), ("z", 3.0, 3, "i3"), ("", 4.0, 4, None), (None, 5.0, 5, None), ("y", 6.0, 6, None)]
    seen = spark.createDataFrame(rows, "alias string, price double, pos int, image_link string").withColumn("image_hash", F.lit("h"))
    out, price = catalog.save(records, prices, sessions, seen, "d", "http://u", 10, now())
    got = {r.id: (r.alias, r.image_link, r.date_sold) for r in out.collect()}
    assert got[1] == ("d_a", "i1", None) and got[3] == ("d_c", None, None) and got[2] == ("d_b", "i", T("2024-05-16T12:00"))
    assert got[4] == ("d_d", None, None) and got[6] == ("d_z", "i3", None) and got[7] == ("d_y", None, None) and len(got) == 7
    assert {(r.record_id, r.price) for r in price.collect()} == {(1, 1.0), (3, 2.0), (6, 3.0), (7, 6.0)}


def test_sessions_by_fields(spark):
    s = spark.createDataFrame([(1, 0), (2, 0)], "id int, found_count int")
    rows = spark.createDataFrame([(1, "a", "", "c")], "session_id int, a string, b string, c string")
    assert {r.id: r.found_count for r in catalog.session_fields(s, rows, ["a", "b", "c"], ["c"]).collect()} == {1: 1, 2: 0}
    assert [r.result for r in catalog.page_status(s.withColumn("found_count", F.col("id")), 2).orderBy("id").collect()] == ["too few records", "ok"]
    runs = spark.createDataFrame([(1, "x")], "id int, scheduler_id string")
    assert catalog.start_runs(runs, runs.withColumn("id", F.lit(2))).count() == 2


def test_api(spark):
    from pagewright.operators import api

    rows = spark.createDataFrame([(2, "b"), (1, "a")], "id int, v string")
    assert [r.v for r in api.one_page("records", rows, ["id"], 1, 1).rows.collect()] == ["a"]
    for page, size in ((3, 1), (0, 1), (1, 0)):
        with pytest.raises(api.BadRequest):
            api.one_page("records", rows, ["id"], page, size)
    day = F.lit("2024-05-17").cast("date")
    assert api.valid_day("2024-05-16'", day, rows) == "2024-05-16" and api.valid_day(None, day, rows) is None
    with pytest.raises(api.BadRequest):
        api.valid_day("2024-05-17", day, rows)
    cache = api.entry(rows, "ALL", F.lit(None), ["id"])
    assert [r.v for r in api.cached_first(cache, "ALL", None, lambda: rows.limit(0)).collect()] == ["a", "b"]
    assert api.cached_first(cache, "DAILY", "2024-05-01", lambda: rows.limit(1)).count() == 1
    assert api.refreshed(cache, api.entry(rows, "ALL", F.lit("2024-05-01"), ["id"]), day, 3).count() == 2


def test_work_items():
    from pagewright.sources.settings import WorkItem

    assert WorkItem("d", "l", "u", "vdp").translate and not WorkItem("d", "l", "u").translate
    with pytest.raises(ValueError, match="unknown kind"):
        WorkItem("d", "l", "u", "x")
