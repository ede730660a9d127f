"""The exchange in two levels gives what one level gives, and its rows grow as stated."""

import random

import numpy as np
import pytest
from test_jaccard import brute as similar
from test_jaccard import corpus as copies
from test_repeats import brute_bytes, brute_words
from test_repeats import corpus as passages

from pagewright.llm import common, jaccard, lm, repeats


@pytest.fixture()
def two_levels(monkeypatch):
    monkeypatch.setattr(common, "FAN", 2)
    for module in (repeats, jaccard):
        monkeypatch.setattr(module, "BLOCK", 3000)


def test_bytes_and_words(spark, two_levels):
    rows = passages(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.suffix_array_dedup(df).collect()}
    assert got == brute_bytes(rows, 50)
    for most in (4096, 0):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.substring_dedup(df, most=most).collect()}
        assert got == brute_words(rows, 20)


def test_similar(spark, two_levels):
    rows = copies(6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(df, 4, 85, heavy=4).collect()), key=str)
    assert got == similar(rows, 4, 85)


def test_language_model(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(k, " ".join(rnd.choices("abcdefg", k=rnd.randrange(0, 90)))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = {r.doc_id: r for r in lm.deleted_interpolation(df, order=3, block_bytes=1500).collect()}
    monkeypatch.setattr(common, "FAN", 2)
    two = {r.doc_id: r for r in lm.deleted_interpolation(df, order=3, block_bytes=1500).collect()}
    for k, r in one.items():
        assert r[:5] == two[k][:5] and np.allclose(r[5:], two[k][5:], rtol=1e-9)


def test_growth(monkeypatch):
    """A block writes at most ``FAN`` blobs, or about the square root of the number of blocks."""

    class Packed:
        def __init__(self, n):
            self.n = n

        def select(self, _):
            return self

        def count(self):
            return self.n

    for n in (1, 100, common.FAN, common.FAN + 1, 125_000, 12_500_000):
        x = common.exchange_for(Packed(n))
        assert x.parts >= n and x.parts == x.ranges * x.spans
        assert x.ranges <= (max(8, n) if n <= common.FAN else n**0.5 + 1)
        assert x.parts * x.teams <= 2 * max(8, n) ** 1.5 or x.spans == 1
