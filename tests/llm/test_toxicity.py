"""Toxicity: held-out accuracy, located sentences, and plain re-scoring."""

import math
import random

import pytest

from pagewright.llm import common, toxicity


def corpus(n=600):
    rnd = random.Random(1)
    clean, bad = [f"w{k}" for k in range(60)], ["gruk", "GRUKAI", "grukoso", "blem"]
    docs, labels = [], []
    for k in range(n):
        said = [[rnd.choice(clean) for _ in range(rnd.randrange(3, 12))] for _ in range(rnd.randrange(1, 12))]
        toxic = int(rnd.random() < 0.3)
        if toxic:
            for _ in range(2):
                rnd.choice(said).insert(0, rnd.choice(bad))
        docs.append((k, ". ".join(" ".join(s) for s in said), "ignored"))
        labels.append((k, toxic))
    return docs, labels


def test_held_out_and_location(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    got = toxicity.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert {r.held_out for r in got if common.crc(r.doc_id) % 5} == {False} and len(got) == len(docs)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    text = {d[0]: d[1] for d in docs}
    for r in got:
        if r.predicted and truth[r.doc_id]:
            s = text[r.doc_id][r.worst_start : r.worst_start + r.worst_length].lower()
            assert "gruk" in s or "blem" in s


def test_long_clean_texts(spark):
    """A text doesn't become toxic by its length; one offending sentence still tells."""
    docs, labels = corpus()
    model = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    rnd = random.Random(2)
    long = ". ".join(" ".join(rnd.choice([f"w{k}" for k in range(60)]) for _ in range(4)) for _ in range(100_000))
    never = toxicity.fit([(0, toxicity.sentences("a. b"))])
    assert toxicity.rated([long], never, {})[0][0] < 0.1
    score = toxicity.rated([long, long + ". gruk w1 w2"], model, {})[0]
    assert score[0] < 0.1 and score[1] >= 0.5


def test_long_documents_are_learned_from(spark):
    docs, labels = corpus(400)
    docs += [(k, "w3 zarg w5. " + "w1 w2 " * 9000, "x") for k in range(1000, 1030)]
    labels += [(k, 1) for k in range(1000, 1030)]
    model = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.word("zarg") > 0 and model.word("gruk") > 0


def test_scores_are_noisy_or(spark):
    model = toxicity.Model(-3.0, {toxicity.features("bad")[0]: 4.0})
    texts = ["bad", "ok. bad bad", "", None, "...", "a. b! c? d\ne", "x" * 200_000, "Bad day. good day"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(df, model).collect():
        none = 1.0
        for s in toxicity.sentences(texts[r.doc_id]):
            none *= 1 - 1 / (1 + math.exp(-(-3.0 + sum(model.word(w) for w in set(s)))))
        assert r.score == pytest.approx(1 - none, rel=1e-9)
        assert r.predicted == int(r.score >= 0.5)


def test_places_are_of_the_text_as_written():
    model = toxicity.Model(-3.0, {toxicity.features("badword")[0]: 9.0})
    texts = ["\u0130\u0130\u0130\u0130 hello. badword here. ok", "\u0130. x\n\u0130 badword", "badword"]
    for text, (at, n) in zip(texts, toxicity.rated(texts, model, {})[1], strict=True):
        assert text[at : at + n].strip(" ") == {0: "badword here", 1: "\u0130 badword", 2: "badword"}[texts.index(text)]


def test_empty_and_single_label(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, none).count() == 0
    some = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (1, "a")], "doc_id long, text string")
    assert {r.predicted for r in toxicity.toxicity(some, none).collect()} == {0}
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(some, odd).count() == 4
