"""Language identification: held-out accuracy, defined edge cases, one text against plain sums."""

import random

import numpy as np

from pagewright.llm import common, langid


def corpus(n=300):
    rnd = random.Random(2)
    parts = {"aa": ["ka", "to", "ri", "mu"], "bb": ["sch", "en", "ung", "ti"], "cc": ["éa", "ou", "ti", "ri"]}
    out = []
    for k in range(n):
        lang = rnd.choice(list(parts))
        text = " ".join("".join(rnd.choices(parts[lang], k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 40)))
        out.append((k, text, lang))
    return out


def test_held_out(spark):
    rows = corpus()
    extra = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 --", None), (1003, "ka TO ri" * 30_000, None), (None, "schenung", "bb")]
    df = spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.language_id(df).collect()}
    assert len(got) == len(rows) + len(extra)
    held = [(got[d].lang_pred, lang) for d, _, lang in rows if common.crc(d) % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [got[d].lang_pred for d in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_batched_sums_are_the_document_features(spark):
    rows = corpus(80)
    model = langid.fit([(t, lang) for _, t, lang in rows])
    texts = [t for _, t, _ in rows] + ["a", "ab", "x é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in langid.identify(df, model).collect():
        buckets, tf = langid.frequencies(texts[r.doc_id])
        p = langid._softmax((tf @ model.table[buckets] + model.bias) / model.temperature)
        assert abs(p.max() - r.score) < 1e-4 and r.lang_pred in np.array(model.languages)[p > p.max() - 1e-4]


def test_only_letters_count():
    assert [langid.has_letter(t) for t in ("\xbd", "\xb2 \u2167 12_", "12 --", "", "\xbd\xe9", "\u4e2d", "\u02b0")] == [False, False, False, False, True, True, True]


def test_document_frequencies_are_of_all_documents(spark):
    texts = ["ab", "abab", None, "", "xyz", "ab\u0130", "ab"] * 3
    n, df = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), 10)
    want = np.zeros(1 << 10)
    for t in texts:
        want[langid.frequencies(t or "", 10)[0]] += 1
    assert n == len(texts) and (df == want).all()


def test_many_languages(spark):
    """None is left out, whatever their number; the table keeps its bound."""
    rows = [(k, f"{chr(0x4E00 + k % 700)} " * (3 + k % 5), f"l{k % 700:03d}") for k in range(9800)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=3500)
    assert len(model.languages) == 700 and model.table.size <= langid.CELLS + 700


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.language_id(df).collect()] == [("und", 0.0)]
    assert langid.language_id(df.limit(0)).count() == 0
