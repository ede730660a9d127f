"""Every operator on nulls in each column, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from pagewright.llm import jaccard, langid, lm, mixing, neardup, packing, repeats, topk, toxicity
from test_packing import PATH

CLASHES = ["block", "blob", "part", "kind", "vertex", "group", "place", "side", "same", "n", "s", "score", "kept", "rest", "length", "rank", "salt", "toxic", "share", "w", "_mix_n", "epoch", "key", "cell", "id", "weight", "v", "dim"]
TEXTS = ["", " \n\t", "one", "one", "One TWO three four five six.", "é́ ñ \x00 \x1c <|endoftext|>", "word " * 60_000, "x" * 300_000, None, "a.\n" * 3000, "\U0001f600 ퟿"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, None) for k, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, None, None, None, None), (None, "one", "de", "s", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES))).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1), (4, 0), (2, 0), (3, 0), (6, None), (None, 1)], "doc_id long, toxic int")


WORK = {
    "toxicity": lambda d, x: toxicity.toxicity(d, x),
    "clean": lambda d, x: toxicity.clean(d, toxicity.Model(-12.0, {})),
    "langid": lambda d, x: langid.language_id(d),
    "lm": lambda d, x: lm.deleted_interpolation(d),
    "jaccard": lambda d, x: jaccard.similar(d),
    "bytes": lambda d, x: repeats.suffix_array_dedup(d, keep=True, carry=["block", "kept"]),
    "words": lambda d, x: repeats.substring_dedup(d),
    "packing": lambda d, x: packing.pack(d, PATH).where("piece = 0"),
    "mixing": lambda d, x: mixing.mixed(d).where("epoch = 0"),
}


@pytest.mark.parametrize("name", sorted(WORK))
def test_rows_are_kept(docs, labels, name):
    out = WORK[name](docs, labels)
    assert out.count() == docs.count()
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(WORK))
def test_no_rows(docs, labels, name):
    assert WORK[name](docs.limit(0), labels.limit(0)).count() == 0


def test_one_of_each(docs):
    ids = sorted(r.doc_id for r in jaccard.one_of_each(docs).where("doc_id is not null").collect())
    assert ids == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]), (None, [1.0, 0.0]), (20, [1.0, 1e-3]), (40, [1e300, 1e300]), (60, [1.0]), (61, [-1.0]), (0, [1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))


def test_vectors(vectors):
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(vectors).collect()}
    assert got[1] == (3, 0) and got[20] == (3, 0) and got[0] == (3, 0) and got[2] == (0, 2) and got[60] == (0, 60) and got[None] == (0, None)
    assert neardup.near_duplicates(vectors).count() == vectors.count()
    small = vectors.where("vec_id <> 40 or vec_id is null")
    rows = topk.top_k(small, small.where("vec_id % 20 = 0"), k=3).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in rows if r.query_id == 20} == {(20, 1, 1), (20, 2, 1), (20, 3, 0)}
    assert {(r.query_id, r.vec_id, r.score) for r in rows if r.query_id == 60} == {(60, 61, -4096)}
