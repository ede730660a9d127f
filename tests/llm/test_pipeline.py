"""The pipeline on a small table: each stage against what it must do, and all queries registered."""

import hashlib
from collections import defaultdict

import corpus_pipeline
from pagewright.llm import common, queries, toxicity
from test_jaccard import brute as similar
from test_repeats import brute_bytes


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents").limit(120)
    kept = [docs.persist()]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf).persist())
    start, clean, single, cut, mixed, packed = ([r.asDict() for r in df.collect()] for df in kept)
    for df in kept[1:-1]:
        assert df.columns == corpus_pipeline.COLUMNS
    model = toxicity.learn(kept[0], common.table(spark, sf, "labels"))
    bad = {r.doc_id for r in toxicity.score(kept[0], model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in start} - bad
    want = {c for _, _, c in similar([(r["doc_id"], r["text"]) for r in clean], 5, 80)}
    assert sorted(r["doc_id"] for r in single) == sorted(want)
    gone = brute_bytes([(r["doc_id"], r["text"]) for r in single], 50)
    left = {r["doc_id"]: r for r in cut}
    for doc, (n, removed, _, digest) in gone.items():
        if doc in left and removed:
            assert left[doc]["n_chars"] == len(left[doc]["text"]) > 0
        if doc in left and len(left[doc]["text"].encode()) == n - removed:
            assert hashlib.sha256(left[doc]["text"].encode()).hexdigest() == digest
        assert (doc in left) == (removed < n or n == 0)
    assert {r["doc_id"] for r in mixed} == set(left)
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(1 for r in packed if r["piece"] == 0) == len(mixed)


def test_all_ten_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))


def test_ties_extra_columns_and_nulls(spark):
    rows = [(1, "a b c d e f", None, None, 11, "x"), (1, "a b c d e f", None, None, 11, "x"), (None, None, None, None, None, None), (2, "", "en", "s", 0, "y"), (3, "long " * 40_000, "en", "s", 200_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, "").count() > 0, name
    assert corpus_pipeline.STAGES[0][1](spark, docs, "/root/testdata/sf0.001").count() == 5
