"""Both repeated-window operators against brute force."""

import hashlib
import random
import re

import pytest

from pagewright.llm.repeats import Automaton, substring_dedup, suffix_array_dedup


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    vocabulary = ["a", "zur", "né", "kin", "plo", "ta,", "wé.", "or", "is", "gan"]
    passages = [" ".join(rnd.choices(vocabulary, k=40)) for _ in range(4)]
    out = []
    for k in range(n):
        parts = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 60))) for _ in range(3)]
        if k % 3 == 0:
            parts.insert(1, rnd.choice(passages))
        if k % 7 == 0 and out:
            parts = [out[rnd.randrange(len(out))][1] or ""]
        out.append((k * 3, " \n".join(parts)))
    out += [(1000, "x " * 90), (1001, ""), (1002, None), (1003, out[4][1]), (1004, "ab" * 2000), (None, out[5][1])]
    rnd.shuffle(out)
    return out


def brute_bytes(rows, window):
    first, out = {}, {}
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for k, (_, text) in enumerate(rows):
        b = (text or "").encode()
        for p in range(len(b) - window + 1):
            first.setdefault(b[p : p + window], k)
    for k, (doc, text) in enumerate(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < k:
                gone[p : p + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def brute_words(rows, window):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out[doc] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, block string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array_dedup(df).collect()}
    assert got == brute_bytes(rows, 50)


@pytest.mark.parametrize(("seed", "most"), [(1, 4096), (2, 0), (3, 4096)])
def test_words(spark, seed, most):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, most=most).collect()}
    assert got == brute_words(rows, 20)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array_dedup(df).count() == 0
    assert substring_dedup(df, keep=True).count() == 0


def test_long_documents(spark, monkeypatch):
    rnd = random.Random(5)
    text = "".join(rnd.choices("abcdefg h", k=30_000))
    rows = [(1, text), (2, text[:14_000] + "Z" + text[14_000:]), (3, text[100:9000])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_bytes(rows, 50)


def test_automaton():
    a = Automaton()
    a.add(list("abcbc"))
    a.add(list("xbcy"))
    assert list(a.matching(list("zabcbxbcyq"))) == [0, 1, 2, 3, 4, 1, 2, 3, 4, 0]
