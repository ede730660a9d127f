"""What Python workers hold: peaks in proportion to a block, and nothing kept for tasks of another kind."""

import gc
import random
import tracemalloc
import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa

from pagewright.llm import common as C
from pagewright.llm import jaccard, packing, repeats


def block(size: int) -> pa.Table:
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(2, 9))) for _ in range(5000)]
    texts, held = [], 0
    while held < size:
        texts.append(texts[-7] if len(texts) % 20 == 19 else " ".join(rnd.choices(words, k=300)))
        held += len(texts[-1])
    return pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


def peak(work) -> int:
    gc.collect()
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_covered_symbols_take_few_bytes_each():
    size, x = 2 << 20, C.Exchange(1)
    rows = block(size)
    (sent,) = repeats._first_pass("bytes", 50, 20, x)(0, rows)
    (told,) = repeats._decide(False, 4096)(0, [0], [C.unpack(sent["blob"][0])])
    anchors, got = repeats.Anchors(rows, "bytes", 50, 20), {0: [(0, told["blob"][0])]}
    assert peak(lambda: repeats._covered(anchors, got, False)) < 6 * size


def test_runs_are_maximal_and_stay_in_documents():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        off = np.concatenate(([0], np.cumsum(rnd.integers(0, 12, 8)))).astype(np.int64)
        stretches = [(p, q) for lo, hi in zip(off[:-1], off[1:], strict=True) for p in range(lo, hi) for q in range(p + 1, hi + 1) if rnd.random() < 0.04]
        gone, edges = np.zeros(off[-1] + 1, bool), set(off.tolist())
        for p, q in stretches:
            gone[p:q] = True
        found = repeats._merged(np.array([p for p, _ in stretches], np.int64), np.array([q for _, q in stretches], np.int64), off)
        starts = [p for p in range(off[-1]) if gone[p] and (p in edges or not gone[p - 1])]
        ends = [p for p in range(1, off[-1] + 1) if gone[p - 1] and (p in edges or not gone[p])]
        assert (found[0].tolist(), found[1].tolist()) == (starts, ends)


def test_buckets_make_sketch_words_in_turns():
    s = jaccard.Sets(block(8 << 20), 5)
    bands = jaccard.Bands(80, int(s.n.max()))
    whole = s.keys(np.sort(np.unique(s.vertex, return_index=True)[1]), bands)
    found = []
    assert peak(lambda: found.append(jaccard.Buckets(s, bands))) < 55 * len(s.hashes)
    order = np.lexsort((s.vertex[whole[1]], whole[0] >> jaccard.SHORT))
    assert np.array_equal(found[0].keys, (whole[0] >> jaccard.SHORT)[order])
    assert np.array_equal(found[0].vertex, s.vertex[whole[1]][order])


def test_an_encoder_goes_when_a_task_of_another_kind_ends():
    path = public_tokenizers.path("word_bpe_49k.json")
    held = weakref.ref(packing.encoder(path))
    assert packing.encoder(path) is held()
    C.release()
    gc.collect()
    assert held() is None


def test_an_encoder_takes_texts_in_turns_of_few_megabytes():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, texts = packing.Encoder(path), block(packing.TEXT)["text"].to_pylist()
    assert peak(lambda: encode(texts)) < 64 << 20
