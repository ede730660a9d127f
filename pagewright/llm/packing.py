"""Best-fit packing of tokenised documents by a linear grouping scheme.

Lengths above a small share of the sequence are cut into groups of equal
cardinality and rounded up to each group's largest.  Over these few sizes the
best configurations of a sequence are found by linear programming with column
generation; whole multiples of them are filled with actual documents, longest
first in each group, and what is left is placed best-fit by falling length.

All planning works on the histogram of lengths, which has at most as many rows
as a sequence has tokens, and on runs of sequences that are filled alike.  The
plan's size depends on that number, not on the corpus; documents find their
place from their rank among those of equal length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SETTINGS = ((24, 1 / 8), (48, 1 / 4), (24, 1 / 3), (48, 1 / 2))
RECENT, TEXT, WORDS = 300_000, 1 << 22, 1 << 19
BLANKS = np.arange(256, dtype=np.uint8)
BLANKS[[9, 10, 13]] = 32
MARKS = np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch


def byte_letters() -> dict[int, str]:
    """The tokenizer's two characters for each letter from U+00DF to U+00FF, one for each of its bytes."""
    printed = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 256)]
    letter = {b: chr(b) for b in printed}
    letter |= {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)}.difference(printed)))}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xDF, 256)}


class Encoder:
    """Token ids of whole texts as bytes; words between ASCII blanks are encoded once and kept.

    The tokenizer lower-cases, and its pieces never hold a letter before a mark.
    So letters up to U+00FF are made small, unless what follows could be composed with them, and
    a word is cut where an ASCII mark follows such a letter.  Words of small letters up to U+00FF skip the
    tokenizer's first steps, which leave them as they are; all others are given to it whole.
    Texts are cut into words, and words told apart, in numpy and Arrow; only distinct words
    of ``WORDS`` at a time are met one by one.  ``RECENT`` words and those of one turn more are
    kept; when a new turn begins, words not met in the one before are forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # small letters, as characters of their bytes, stay as they are up to the merges
        self.plain.normalizer, self.plain.pre_tokenizer = Sequence([]), WhitespaceSplit()
        self.letters = byte_letters()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)).encode(), re.IGNORECASE).search
        self.known: dict[str, bytes] = {}
        self.before = self.known

    def _joined(self, tokenizer, words: list[str], given: list[str], gap: str) -> None:
        """Many words at a time, with a mark between them that none of them holds."""
        mark = self.tokenizer.encode(gap, add_special_tokens=False).ids
        joined = [f" {gap} ".join(given[k : k + 50]) for k in range(0, len(given), 50)]
        for k, found in enumerate(tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            some = words[50 * k : 50 * k + 50]
            ids = np.array(found.ids, "<u4")
            cut = np.flatnonzero(ids == mark[0]).tolist()
            data = ids.tobytes()
            if len(mark) != 1 or len(cut) != len(some) - 1:
                raise RuntimeError("words and token ids do not match")
            self.known.update(zip(some, (data[4 * lo + 4 : 4 * hi] for lo, hi in zip([-1, *cut], [*cut, len(ids)], strict=True)), strict=True))

    def _learn(self, words: list[str]) -> None:
        """Ids of distinct words that aren't known yet."""
        plain = [w for w in words if PLAIN(w)]
        self._joined(self.plain, plain, [w if w.isascii() else w.translate(self.letters) for w in plain], "!")
        other = {*words}.difference(plain)
        odd = [w for w in other if not w or "\0" in w or "<|" in w]
        self.known.update({w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in odd})
        other = [*other.difference(odd)]
        self._joined(self.tokenizer, other, other, "\0")

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.known) > RECENT:
            self.before, self.known = self.known, {}
        found = list(map(self.known.get, words))
        if None in found:
            new = [w for w, x in zip(words, found, strict=True) if x is None]
            seen = list(map(self.before.get, new))
            self.known.update((w, x) for w, x in zip(new, seen, strict=True) if x is not None)
            self._learn([w for w, x in zip(new, seen, strict=True) if x is None])
            found = list(map(self.known.__getitem__, words))
        return found

    def _cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts with a blank before each word, and where texts begin."""
        whole = b"".join(b" " + t for t in texts)
        data, edges = BLANKS[np.frombuffer(whole, np.uint8)], np.cumsum([0, *(len(t) + 1 for t in texts)])
        if b"<|" in whole and self.special(whole):
            return data, edges
        after = np.append(data[1:], np.uint8(32))
        alone = after < 0xCC  # no combining character begins below
        data[(data >= 65) & (data <= 90) & alone] += 32
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        second = second[~np.isin(data[second], [0x97, 0xB7])]  # signs, not letters
        data[second[(data[second] < 0x9F) & alone[second]]] += 32
        letters = (data >= 97) & (data <= 122)
        letters[second] = True
        cut = np.flatnonzero(letters & MARKS[after]) + 1
        return np.insert(data, cut, 32), edges + np.searchsorted(cut, edges)

    def __call__(self, texts: list[str]) -> list[bytes]:
        data, edges = self._cut([t.encode() for t in texts])
        starts = np.append(np.flatnonzero(data == 32), len(data))  # each word has a blank before it
        ids, upto, total = [], [np.zeros(1, np.int64)], 0
        for lo in range(0, len(starts) - 1, WORDS):
            cut = starts[lo : lo + WORDS + 1]
            words = pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut.astype("<i4")), pa.py_buffer(data)).dictionary_encode()
            _, ends, distinct = words.dictionary.buffers()
            distinct = str(memoryview(distinct)[: np.frombuffer(ends, "<i4")[len(words.dictionary)]], "utf-8").split(" ")[1:]
            parts = self._ids(distinct)
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            at = words.indices.to_numpy()
            n = sizes[at]
            ends = np.cumsum(n)
            first = (np.cumsum(sizes) - sizes)[at] - ends + n
            ids.append(np.frombuffer(b"".join(parts), "<u4")[np.arange(ends[-1]) + np.repeat(first, n)].tobytes())
            upto.append(ends + total)
            total += int(ends[-1])
        ids = b"".join(ids)
        edges = (4 * np.concatenate(upto)[np.searchsorted(starts, edges)]).tolist()
        return [ids[lo:hi] for lo, hi in zip(edges, edges[1:], strict=False)]


def encoder(path: str) -> Encoder:
    """One for each Python worker, whatever the number of its packing tasks; what it keeps is bounded."""
    return C.kept(path, lambda: Encoder(path))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end: int = 1, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of ``capacity`` only where longer."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * keep_ids)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] * keep_ids)]
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT, side="right")))
                some, out = batch.slice(at, upto - at), []
                for key, ids in zip(some["doc_id"].to_pylist(), encode([t or "" for t in some["text"].to_pylist()]), strict=True):
                    ids += tail
                    for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[lo : lo + 4 * capacity]
                        out.append((key, k, lo // 4, len(piece) // 4, zlib.crc32(piece), *([np.frombuffer(piece, "<i4")] * keep_ids)))
                at = upto
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        C.release(keep=True)

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


# ------------------------------------------------------------------------ plan


def groups_of(counts: np.ndarray, large: int, groups: int) -> list[list[tuple[int, int, int]]]:
    """Lengths from ``large`` up, longest first, in groups of equal cardinality: (length, rank, n) stretches."""
    lengths = np.flatnonzero(counts)[::-1]
    lengths = lengths[lengths >= large]
    total = int(counts[lengths].sum())
    out, room = [], 0
    for length in lengths.tolist():
        rank, left = 0, int(counts[length])
        while left:
            if not room:
                out.append([])
                room = -(-total // groups)
            n = min(left, room)
            out[-1].append((length, rank, n))
            rank, left, room = rank + n, left - n, room - n
    return out


def best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that is worth most."""
    worth, steps = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        best, choice = worth.copy(), np.full(capacity + 1, -1)
        for k, s in enumerate(sizes):
            value = worth[: capacity + 1 - s] + prices[k]
            better = value > best[s:] + 1e-12
            best[s:][better] = value[better]
            choice[s:][better] = k
        if (choice < 0).all():
            break
        steps.append(choice)
        worth = best
    config, room = np.zeros(len(sizes), np.int64), capacity
    for choice in reversed(steps):
        if choice[room] >= 0:
            config[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(config @ prices), config


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Configurations and how often to use each (fractional): column generation by the revised simplex method."""
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.linalg.inv(basis)
    amount = inverse @ demand
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        value, column = best_configuration(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-7:
            break
        column = column.astype(float)
        direction = inverse @ column
        ratio = np.full(n, np.inf)
        ratio[direction > 1e-9] = amount[direction > 1e-9] / direction[direction > 1e-9]
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        inverse = np.linalg.inv(basis)
        amount = np.maximum(inverse @ demand, 0)
    return basis.T.astype(np.int64), amount


def plan(counts: np.ndarray, capacity: int, settings: tuple[tuple[int, float], ...] = SETTINGS) -> tuple[np.ndarray, int]:
    """The plan with the fewest sequences among those of all settings (groups, share)."""
    return min((planned(counts, capacity, *s) for s in settings), key=lambda x: x[1])


def planned(counts: np.ndarray, capacity: int, groups: int, share: float) -> tuple[np.ndarray, int]:
    """Runs (length, rank, n, sequence, offset) and the number of sequences.

    ``counts[length]`` pieces of each length are placed: those of ``length`` with
    ranks rank..rank+n-1 go to sequences sequence..sequence+n-1, each at ``offset``.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    placed, sequences = np.zeros(capacity + 1, np.int64), 0
    ready: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (sequence, n)
    full = int(counts[capacity])
    if full:
        runs.append((capacity, 0, full, 0, 0))
        placed[capacity], sequences = full, full
    rest = counts.copy()
    rest[capacity] = 0
    own = groups_of(rest, int(capacity * share) + 1, groups)
    taken: dict[int, list[tuple[int, int]]] = {}  # ranks of a length that configurations have used
    if own:
        sizes = np.array([g[0][0] for g in own])
        demand = np.array([sum(n for *_, n in g) for g in own], float)
        merged = np.unique(sizes)[::-1]
        need = np.array([demand[sizes == s].sum() for s in merged])
        streams = {int(s): [x for g, t in zip(own, sizes, strict=True) if t == s for x in g] for s in merged}
        cursor = {int(s): [0, 0] for s in merged}
        configs, amount = configurations(merged, need, capacity)
        for config, x in zip(configs, np.floor(amount + 1e-6).astype(np.int64), strict=True):
            x = int(x)
            left = {int(s): sum(n for *_, n in streams[int(s)][cursor[int(s)][0] :]) - cursor[int(s)][1] for s in merged[config > 0]}
            x = min([x, *(left[int(s)] // int(a) for s, a in zip(merged, config, strict=True) if a)])
            if x <= 0 or not config.any():
                continue
            layers, cuts = [], {0, x}
            for s, a in zip(merged, config, strict=True):
                for _ in range(int(a)):
                    layer, at = [], 0
                    while at < x:  # the next x documents of the group, longest first
                        k, used = cursor[int(s)]
                        length, rank, n = streams[int(s)][k]
                        m = min(n - used, x - at)
                        layer.append((at, length, rank + used))
                        taken.setdefault(length, []).append((rank + used, m))
                        cuts.add(at + m)
                        at += m
                        cursor[int(s)] = [k + 1, 0] if used + m == n else [k, used + m]
                    layers.append(layer)
            edges = sorted(cuts)
            starts = [np.array([p[0] for p in layer]) for layer in layers]
            for lo, hi in zip(edges, edges[1:], strict=False):
                offset = 0
                for layer, start in zip(layers, starts, strict=True):
                    at, length, rank = layer[int(np.searchsorted(start, lo, side="right")) - 1]
                    runs.append((length, rank + lo - at, hi - lo, sequences + lo, offset))
                    offset += length
                ready[capacity - offset].append((sequences + lo, hi - lo))
            sequences += x
    some = np.array([bool(r) for r in ready])
    for length in range(capacity - 1, 0, -1):
        free, at = [], 0
        for rank, n in sorted(taken.get(length, [])):
            if rank > at:
                free.append((at, rank - at))
            at = rank + n
        if at < int(rest[length]):
            free.append((at, int(rest[length]) - at))
        for rank, n in free:
            while n:
                room = length + int(some[length:].argmax())
                if not some[room]:
                    ready[capacity].append((sequences, max(1, n // (capacity // length))))
                    sequences += ready[capacity][-1][1]
                    some[room := capacity] = True
                first, m = ready[room].pop()
                k = min(m, n)
                runs.append((length, rank, k, first, capacity - room))
                if k < m:
                    ready[room].append((first + k, m - k))
                some[room] = bool(ready[room])
                ready[room - length].append((first, k))
                some[room - length] = True
                rank, n = rank + k, n - k
    out = np.array(runs, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))], sequences


def ranked(rows: DataFrame, salts: int) -> DataFrame:
    """``rank`` of each row among those of its length, from 0, by sums over salts: no length meets in one task.

    ``rows`` are checkpointed, so that their places stay; they tell rows apart that are alike in all columns.
    """
    salted = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("at")) - 1
    salted = salted.withColumn("within", within).join(before.drop("n"), ["length", "salt"])
    return salted.withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("within")).drop("salt", "before", "within", "at")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end: int = 1, settings: tuple[tuple[int, float], ...] = SETTINGS, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place.

    Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and
    ``ids`` if kept).  A null or empty text is its end id alone.  Rows that repeat,
    or share a doc_id, are packed each.  ``settings``: into how many groups lengths
    above which share of the capacity are rounded; the best of them counts.
    """
    rows = C.checkpointed(pieces(docs, tokenizer_path, capacity, end, keep_ids))
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        counts[r.length] = r["n"]
    runs, _ = plan(counts, capacity, settings)
    salts = max(16, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = runs[:, 0] << 48 | runs[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = runs[np.searchsorted(key, length << 48 | rank, side="right") - 1]
            columns = {n: batch[n] for n in batch.schema.names if n != "rank"}
            columns |= {"sequence_id": pa.array(at[:, 3] + rank - at[:, 1]), "offset": pa.array(at[:, 4].copy())}
            yield pa.RecordBatch.from_pydict(columns)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * keep_ids)]
    return ranked(rows, salts).select(*names, "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long")
