"""Sources, settings, the stream of pages, and the driver's contract."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagewright.plans.registry import ORACLES, QUERIES
from pagewright.rules import Rule
from pagewright.sources import settings, tables
from pagewright.streaming import ingest

LIST = "<ul>" + "".join("<li><a href='/{0}'>item</a></li>".format(k) for k in ("a", "b", "c")) + "</ul>"
RULES = [Rule("alias", tags={"regex_driven", "attribute"}, regex=r"/\w+", attribute_regex="^href$", required=True), Rule("title", tags={"regex_driven", "text"}, regex=r"[a-z]+", required=True)]


def test_lookups_and_words(spark, tmp_path):
    spark.createDataFrame([(2, "b"), (1, "a")], "id int, name string").write.parquet(str(tmp_path / "one.parquet"))
    spark.createDataFrame([(1, "a", 3)], "id int, name string, n int").write.parquet(str(tmp_path / "two.parquet"))
    known = tables.Lookups(spark, str(tmp_path))
    assert known.values("one") == ["a", "b"] and known.values("two") == [("a", 3)]
    known.refresh()
    assert known.known == {}
    (tmp_path / "words").write_text("the\n of \n\nthe\n")
    assert tables.word_list(spark, str(tmp_path / "words")) == ["of", "the"]


def test_images(spark):
    rows = spark.createDataFrame([(1, 0, "l0", None), (1, 1, "l1", bytearray(b"x")), (2, 0, "l2", bytearray(b"default")), (2, 1, "l3", bytearray(b"y"))], "record int, pos int, link string, content binary")
    defaults = spark.createDataFrame([(bytearray(b"default"),)], "c binary").select(F.sha2("c", 256).alias("hash"))
    assert [(r.record, r.link) for r in tables.first_image(rows, defaults).collect()] == [(1, "l1")]


def test_settings(spark):
    rows = [("s", "a_scraper_settings", '{"x": 1}'), ("s", "n", "2"), ("t", "n", "3")]
    c = settings.Config.of_table(spark.createDataFrame(rows, "scheduler_id string, name string, value string"), "s", ["n"])
    assert c.get("n") == 2 and c.of_type("x", "a") == 1 and c.of_type("y", "a", 5) == 5 and c.get("z") is None
    with pytest.raises(settings.MissingSettings):
        settings.Config({}, ["n"])


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "pages"), str(tmp_path / "catalog")
    for k, html in enumerate([LIST, LIST.replace("/a", "/d")]):
        spark.createDataFrame([(k, "http://h", html, dt.datetime(2024, 1, 1))], ingest.PAGES).write.mode("append").parquet(source)
        ingest.ingest(ingest.read_pages(spark, source), RULES, out, str(tmp_path / "state")).awaitTermination()
        assert {r.alias for r in spark.read.parquet(out).collect()} == ({"/a", "/b", "/c"} if k == 0 else {"/a", "/b", "/c", "/d"})
    assert spark.read.parquet(out).count() == 4
    stream = ingest.new_records(ingest.read_pages(spark, source), RULES)
    q = stream.writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fresh").count() == 4


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and set(QUERIES) <= set(names)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    """Each query runs; those with SQL return as many rows and the same columns there."""
    df = QUERIES[name](spark, sf)
    n = df.count()
    if name in ORACLES:
        with duckdb.connect() as con:
            for t in "region nation customer supplier part orders lineitem events documents pages labels".split():
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
            result = con.execute(ORACLES[name])
            assert sorted(c[0] for c in result.description) == sorted(df.columns)
            assert len(result.fetchall()) == n
    else:
        assert n > 0
