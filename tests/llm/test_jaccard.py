"""Similar documents against all pairs."""

import random
import re

import pytest

from pagewright.llm import jaccard


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    label = [float("inf") if d is None else d for d, _ in rows]
    while True:
        before = list(label)
        for a in range(len(rows)):
            for b in range(len(rows)):
                i = len(sets[a] & sets[b])
                if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return sorted(((d, len(s), None if x == float("inf") else x) for (d, _), s, x in zip(rows, sets, label)), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "ABC", "x,"]
    out = []
    for k in range(25):
        base = rnd.choices(vocabulary, k=rnd.choice([1, 2, 3, 5, 9, 30, 80, 200]))
        for _ in range(rnd.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 25)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            out.append(rnd.choice([" ", "\n "]).join(copy))
    rows = [(7 * k % 1009, t) for k, t in enumerate(out)]
    rnd.shuffle(rows)
    return [*rows, (2000, None), (2001, ""), (2002, " \n"), (2003, rows[3][1].upper()), (2004, "w1 " * 5000), (2005, "w1 " * 6000), (None, rows[4][1]), (None, "alone here")]


@pytest.mark.parametrize(("seed", "width", "percent", "heavy"), [(1, 4, 85, 1024), (2, 5, 80, 1024), (3, 4, 85, 2), (4, 2, 60, 1024)])
def test_against_all_pairs(spark, seed, width, percent, heavy):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, vertex int").repartition(3)
    got = jaccard.similar(df, width, percent, heavy=heavy).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, width, percent)


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_bands_hold_all_partners(percent):
    bands = jaccard.Bands(percent, 3000)
    for a in range(1, 1500):
        b = a * 100 // percent
        assert bands.of(b) - bands.of(a) in (0, 1)
        assert bands.most(a, b) <= bands.differ(bands.of(b))


def test_words_of_a_pattern(spark):
    """A word of 1024 letters whose pattern any polynomial modulo a power of two takes for its complement's."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word), (4, f"x {word} y"), (5, f"x {word} z")]
    got = {r.doc_id: r.component_id for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_empty(spark):
    assert jaccard.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
