"""Typed attribute parsing on the cases the operators are specified by."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import links, scalars, text

FLOATS = [
    ("3,950", 3950.0), ("2.470", 2470.0), ("12 700", 12700.0), ("26.950 €", 26950.0), ("1.250.950", 1250950.0), ("23.500,-", 23500.0),
    ("137 km", 137.0), ("100,7", 100.7), ("2132", 2132.0), ("12 thd", 12.0), ("120thd", 120.0), ("15,6 thd", 15.6), ("", None), ("n/a", None), ("1.2.3", None), ("-5", 5.0), ("12.345", 12345.0), (None, None),
]
DATES = [
    ("17.05.2024", "2024-05-17"), ("17/05/2024", "2024-05-17"), ("05.2024", "2024-05-01"), ("5 2024", "2024-5-01"), ("2024", "2024-01-01"), ("2024.05.17", "2024-05-01"),
    ("2024-05-17", "2024-01-01"), ("17-05-2024", "2024-01-01"), ("May 2024", "2024-01-01"), ("17.05.24", None), ("", None), (None, None),
]


def column(spark, rows, expression, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], f"k int, v {kind}")
    return [r[0] for r in df.select("k", expression(F.col("v")).alias("out")).orderBy("k").select("out").collect()]


def test_float(spark):
    assert column(spark, [a for a, _ in FLOATS], scalars.parse_float) == [b for _, b in FLOATS]


def test_int_cuts_toward_zero(spark):
    assert column(spark, ["100,7", "n/a", "2132"], scalars.parse_int) == [100, None, 2132]


def test_units(spark):
    got = column(spark, ["12 thd", "120thd", "15,6 thd", "7 KM", "3"], lambda v: scalars.convert_units(v, [("thd", 1000), ("km", 0.5)]))
    assert got == [12000, 120000, 15600, 7, 3]
    assert column(spark, ["7 KM"], lambda v: scalars.convert_units(v, [("km", 0.5)], ignore_case=True)) == [3.5]


@pytest.mark.parametrize(
    ("discard", "nth", "values", "want"),
    [(None, None, [5, 100, 40], 5), ("30%", None, [5, 100, 40], 100), ("30%", 2, [5, 100, 40], 40), ("30%", 3, [5, 100, 40], 100), (None, 3, [5, 100, 40], 5), (None, 4, [5, 100, 40], 5), ("50", 1, [5, 100, 40], 100), ("30%", 2, [3950, 2470, 12700], 3950), (None, None, [], None)],
)
def test_constraints(spark, discard, nth, values, want):
    assert column(spark, [[float(x) for x in values]], lambda v: scalars.constrained(v, discard, nth), "array<double>") == [want]


def test_dates(spark):
    assert column(spark, [a for a, _ in DATES], scalars.parse_date) == [b for _, b in DATES]
    iso = column(spark, ["2024-05-17", "17-05-2024", "17.5.2024", "5 2024", "x"], lambda v: scalars.parse_date_iso(v).cast("string"))
    assert iso == ["2024-05-17", "2024-05-17", "2024-05-17", "2024-05-01", None]


def test_typed(spark):
    assert column(spark, [["12 thd", "3"], [], None], lambda v: scalars.typed("int", v, [("thd", 1000)], {"prioritize_nth_biggest": 2}), "array<string>") == [3, None, None]
    assert column(spark, [["A", "b"]], lambda v: scalars.typed("text", v, translations={"a": "x"}, ignore_case=True), "array<string>") == ["x"]
    assert column(spark, [["Q"]], lambda v: scalars.typed("text", v, translations={"a": "x"}, ignore_case=True), "array<string>") == ["q"]
    assert column(spark, [["a"]], lambda v: scalars.typed("nonsense", v), "array<string>") == [None]
    assert column(spark, ["1,234.50", "x"], lambda v: scalars.typed_static("float", v, F.lit(-1.0))) == [1234.5, -1.0]
    with pytest.raises(ValueError, match="unknown"):
        scalars.typed_static("nonsense", F.col("v"))


def test_hash(spark):
    assert column(spark, [bytearray(b"123"), bytearray(b""), None], scalars.content_hash, "binary") == ["a665a45920422f9d417e4867efdc4fb8a04a1f3fff1fa07e998e86f7f7a27ae3", None, None]


def test_title(spark):
    got = column(spark, ["Fast RING x9 red", "blue bolt", None], lambda v: scalars.split_title(v, ["Ring"], r"x\d").getField("make"))
    assert got == ["Ring", None, None]
    assert column(spark, ["Fast RING x9 red"], lambda v: scalars.split_title(v, ["Ring"], r"x\d").getField("model")) == ["x9"]


def test_api_date(spark):
    got = column(spark, ["2024-05-30'", "2024-06-01", "2024-13-01", "x"], lambda v: scalars.api_date(v, F.lit("2024-06-01").cast("date")).cast("string"))
    assert got == ["2024-05-30", None, None, None]


@pytest.mark.parametrize(
    ("link", "url", "want"),
    [(None, "http://a", None), ("http://b", "http://a", "http://b"), ("www.b", "http://a/", "www.b"), ("/x", "http://a/", "http://a/x"), ("x", "http://a/", "http://a/x"), ("x", "http://a", "http://a/x"), ("/x", "http://a", "http://a//x")],
)
def test_links(spark, link, url, want):
    df = spark.createDataFrame([(link, url)], "l string, u string")
    assert df.select(links.format_link(F.col("l"), F.col("u"))).first()[0] == want


@pytest.mark.parametrize("ref", ["x", "/x", "//h/x", "?q", "#f", "", "http://z/y", "mailto:a@b", "y/z?k=1", "../x", "./x", "../../../x?a=../b", "a/../b/./c", "/a/../b", "..", ".", "a/..", "/.", "x/../#f", "a..b/.c"])
@pytest.mark.parametrize("url", ["http://a.com/b/c?d#e", "https://a.com", "http://a.com/b/"])
def test_absolute(spark, ref, url):
    from urllib.parse import urljoin

    df = spark.createDataFrame([(ref, url)], "r string, u string")
    assert df.select(links.absolute(F.col("r"), F.col("u"))).first()[0] == urljoin(url, ref)


def test_same_site(spark):
    rows = [("/x", "http://www.a.com/p", True), ("p", "http://a.com/p", False), ("http://a.org/q", "http://a.com/p", True), ("http://b.com/q", "http://a.com/p", False), ("", "http://a.com", False), (None, "http://a.com", True), ("#", "http://a.com/p", True)]
    df = spark.createDataFrame(rows, "l string, u string, w boolean")
    assert all(r.w == r.got for r in df.withColumn("got", links.same_site(F.col("l"), F.col("u"))).collect())


def test_text(spark):
    assert column(spark, ["a  \n\x00b ", None], text.collapse_blanks) == ["a b ", None]
    assert column(spark, ["HERE ? ! . x"], lambda v: text.punctuation_blanks(v, ["!", "?"])) == ["HERE?! . x"]
    assert column(spark, ["a | b|c $"], lambda v: text.redundant_punctuation(v, ["|", "$"])) == ["a b c "]
    assert column(spark, ["a<!-- x\n-->b<!---->"], text.strip_comments) == ["ab"]
    assert column(spark, ["The other"], lambda v: text.remove_stopwords(v, ["the", ""])) == [" or"]


def test_alias(spark):
    df = spark.createDataFrame([("a", "d"), ("", "d"), (None, "d")], "a string, d string")
    assert [r[0] for r in df.select(links.namespaced(F.col("a"), F.col("d"))).collect()] == ["d_a", None, None]
