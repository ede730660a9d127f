"""Repeated windows across a corpus: exact, with work in proportion to the text.

Two windows of T symbols can only be equal if the least hash among their k-grams
stands at the same place in both.  So each document is cut into *anchors* (such
k-grams with the run of windows they stand for), and the windows of a corpus are
ordered digit by digit, the most significant first:

1. by the anchor's k symbols.  Groups with one span are done.
2. by the anchor's whole span (all symbols of its windows).  Every occurrence of
   a span but the first is a repeat.
3. first occurrences of spans in groups with several are ordered by all T symbols
   of each window, or streamed through suffix automata.

A block sends each distinct span once (of an anchor with many spans, one event),
so a passage in a third of all documents costs a few events per block.  Equal
hashes count as equal: a match needs two independent ones to agree, 80 bits or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Of an anchor: no earlier one, an earlier one elsewhere, undecided, undecided and frequent.
FIRST, LATER, OPEN, HOT = 0, 1, 2, 3
CHUNK = {"bytes": 1 << 19, "words": 1 << 18}
BLOCK = 8 << 20
#: These bits of a gram's hash hold its place, so that the leftmost of equal ones is the least.
LOW = np.uint64((1 << 22) - 1)
#: Anchors and spans travel as 48 bits each; a window as 56 bits and 24 bits of its anchor.
SHORT, CHECK = np.uint64(16), np.uint64((1 << 24) - 1)
#: A block sends each span of an anchor that has no more than these; of others, one event.
FEW = 8


class Anchors:
    """All anchors of a block, in document order."""

    def __init__(self, rows: pa.Table, unit: str, window: int, gram: int):
        self.ids, self.window = C.ids(rows), window
        data, offsets = C.raw(rows["text"])
        self.data, self.byte_offsets = data, offsets
        if unit == "words":
            self.hashes, self.starts, self.ends, offsets = C.words(data, offsets, lower=False)
        self.offsets, self.unit = offsets, unit
        found = [self._chunk(lo, hi, gram) for lo, hi in self._chunks()]
        cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64)]
        self.gram, self.span, self.first, self.last = cols
        self.doc = np.searchsorted(offsets, self.first, side="right") - 1
        self._group()

    def symbols(self, lo: int, hi: int) -> np.ndarray:
        return C.BYTE_VALUES[self.data[lo:hi]] if self.unit == "bytes" else self.hashes[lo:hi]

    def _chunks(self) -> Iterator[tuple[int, int]]:
        """Documents together up to a size; a longer one by itself, in overlapping stretches."""
        at, n, size = 0, len(self.offsets) - 1, CHUNK[self.unit]
        while at < n:
            upto = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + size, side="right")) - 1)
            lo, hi = int(self.offsets[at]), int(self.offsets[upto])
            while hi - lo > 2 * size:
                yield lo, lo + size + self.window - 1
                lo += size
            if hi - lo >= self.window:
                yield lo, hi
            at = upto

    def _chunk(self, lo: int, hi: int, k: int) -> tuple[np.ndarray, ...]:
        symbols, window = self.symbols(lo, hi), self.window
        n, width = len(symbols), window - k + 1
        roll = C.Rolling(symbols)
        grams = roll.every(k)
        low = LOW if n <= int(LOW) else np.uint64((1 << int(n).bit_length()) - 1)
        least = grams & ~low | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        crossing = np.zeros(n + 1, np.int32)
        inner = self.offsets[np.searchsorted(self.offsets, lo, side="right") : np.searchsorted(self.offsets, hi)] - lo
        np.add.at(crossing, np.maximum(inner - window + 1, 0), 1)
        np.add.at(crossing, inner, -1)
        start = np.flatnonzero(np.cumsum(crossing[: len(least)]) == 0)
        if not len(start):
            return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        at = (least[start] & low).astype(np.int64)
        fresh = np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)))
        edge = np.flatnonzero(fresh)
        first, last, at = start[edge], start[np.append(edge[1:], len(start)) - 1], at[edge]
        shape = ((at - first) << 20 | (last - first)).astype(np.uint64)
        span = C.mix(roll.of(first, last + window) ^ shape * np.uint64(0x9E3779B97F4A7C15))
        return C.mix(grams[at] ^ np.uint64(0xA5A5A5A5)), np.maximum(span, np.uint64(1 << 16)), first + lo, last + lo

    def _group(self) -> None:
        """Groups of equal anchors, and in them classes of equal spans, led by the first in document order."""
        n = len(self.gram)
        order = np.lexsort((self.span, self.gram))
        group = C.runs(self.gram[order])
        start = np.unique(np.concatenate((group, C.runs(self.span[order]))))
        self.lead = order[start]
        self.of_class = np.empty(n, np.int64)
        self.of_class[order] = C.spread(np.arange(len(start)), start, n)
        first = np.searchsorted(start, group)
        count = np.diff(np.append(first, len(start)))
        alone = C.spread(count <= FEW, first, len(start))
        event = alone.copy()
        event[first] = True
        self.of_event = np.cumsum(event) - 1
        self.sent = np.flatnonzero(event)
        self.sizes = np.where(alone, 1, C.spread(count, first, len(start)))[self.sent]
        self.shape = np.where(alone, self.span[self.lead], np.uint64(0))[self.sent]
        least = np.minimum.reduceat(self.ids[self.doc[self.lead]], first) if n else np.zeros(0, np.int64)
        self.least = np.where(alone, self.ids[self.doc[self.lead]], C.spread(least, first, len(start)))[self.sent]
        self.keys = self.gram[self.lead[self.sent]]

    def events(self) -> tuple[np.ndarray, ...]:
        """Anchor, span (0: many of them), smallest id and number of spans of each event."""
        return self.keys >> SHORT, self.shape >> SHORT, self.least, self.sizes.astype(np.uint32)

    def coded(self, codes: np.ndarray) -> np.ndarray:
        return codes[self.of_event[self.of_class]]

    def leaders(self, codes: np.ndarray, code: int, same_doc: bool) -> np.ndarray:
        """Anchors with this code, one of each span; with ``same_doc``, all of the first one's id."""
        at = np.flatnonzero(self.coded(codes) == code)
        lead = self.lead[self.of_class[at]]
        return at[self.ids[self.doc[at]] == self.ids[self.doc[lead]] if same_doc else at == lead]

    def windows(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, hash and anchor of each window of these anchors."""
        at = C.ranges(self.first[anchors], self.last[anchors] + 1)
        own = np.repeat(anchors, self.last[anchors] + 1 - self.first[anchors])
        hashes = np.empty(len(at), np.uint64)
        for lo, hi in self._chunks():
            a, b = np.searchsorted(at, [lo, hi - self.window + 1])
            if b > a:
                hashes[a:b] = C.mix(C.Rolling(self.symbols(lo, hi)).of(at[a:b] - lo, at[a:b] - lo + self.window) + np.uint64(0x51ED2701))
        return at, hashes, own


def _first_pass(unit: str, window: int, gram: int, x: C.Exchange):
    def work(block: int, rows: pa.Table) -> Iterator[dict]:
        a = Anchors(rows, unit, window, gram)
        keys, shape, ids, sizes = a.events()
        bounds = x.cut(a.keys)
        full = np.flatnonzero(np.diff(bounds)).tolist()
        yield {"part": full, "block": [block] * len(full), "blob": [C.pack(*(c[bounds[p] : bounds[p + 1]] for c in (keys, shape, ids, sizes)), ascending=1) for p in full]}

    return work


def _decide(automata: bool, most: int):
    def work(part: int, own: list[int], arrays: list[list[np.ndarray]]) -> Iterator[dict]:
        keys, shape, ids, sizes = (np.concatenate(x) for x in zip(*arrays, strict=True))
        n = len(keys)
        order = np.lexsort((shape, keys))
        group = C.runs(keys[order])
        same = np.unique(np.concatenate((group, C.runs(shape[order]))))
        first = C.spread(np.minimum.reduceat(ids[order], same), same, n)
        many = (np.diff(np.append(np.searchsorted(same, group), len(same))) > 1) | (shape[order][group] == 0)
        total = np.add.reduceat(sizes[order].astype(np.int64), group)
        code = C.spread(np.where(many, np.where((total > most) | (not automata), HOT, OPEN), FIRST), group, n)
        code[(shape[order] != 0) & (ids[order] > first)] = LATER
        out = np.empty(n, np.uint8)
        out[order] = code
        bounds = np.cumsum([0, *(len(a[0]) for a in arrays)])
        yield {"block": own, "kind": [0] * len(own), "part": [part] * len(own), "blob": [C.pack(out[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]}

    return work


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by hash, earlier first among equals, and where each run starts."""
    order = np.argsort(hashes, kind="stable")
    return order, C.runs(hashes[order])


def _second_pass(unit: str, window: int, gram: int, x: C.Exchange, within: bool):
    """Of the open groups: windows by hash (kind 1), spans by anchor (kind 2)."""

    def work(block: int, rows: pa.Table, got: dict) -> pa.Table:
        a = Anchors(rows, unit, window, gram)
        codes, out = C.codes(got, 0, len(a.keys), np.uint8), []
        lead = a.leaders(codes, HOT, not within)
        if len(lead):
            at, hashes, own = a.windows(lead)
            order, start = _distinct(hashes)
            lead_of = order[start]
            keys = hashes[lead_of]
            bounds = x.cut(keys)
            for p in np.flatnonzero(np.diff(bounds)):
                s = slice(bounds[p], bounds[p + 1])
                out.append((2 * int(p), block, C.pack(keys[s] >> np.uint64(8), (a.gram[own[lead_of[s]]] & CHECK).astype(np.uint32), a.ids[a.doc[own[lead_of[s]]]], ascending=1)))
        lead = a.leaders(codes, OPEN, False)
        if len(lead):
            lead = lead[np.argsort(a.gram[lead], kind="stable")]
            bounds = x.cut(a.gram[lead])
            for p in np.flatnonzero(np.diff(bounds)):
                own = lead[bounds[p] : bounds[p + 1]]
                n = a.last[own] + window - a.first[own]
                out.append((2 * int(p) + 1, block, C.pack(a.gram[own], a.ids[a.doc[own]], a.first[own], n.astype(np.uint32), a.hashes[C.ranges(a.first[own], a.first[own] + n)], ascending=1)))
        return pa.Table.from_pydict(dict(zip(("part", "block", "blob"), map(list, zip(*out, strict=True)) if out else ([], [], []), strict=True)), schema=C.ARROW_EVENTS)

    return work


class Automaton:
    """A suffix automaton of several sequences, added one after another."""

    def __init__(self):
        self.next, self.link, self.size = [{}], [-1], [0]

    def _copy(self, p: int, symbol: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._copy(last, symbol, q)
                continue
            new = len(self.next)
            self.next.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._copy(p, symbol, q)
            last = new

    def matching(self, sequence: list[int]) -> Iterator[int]:
        """At each symbol, the length of the longest match that ends there."""
        state, length = 0, 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if (to := self.next[state].get(symbol)) is not None:
                state, length = to, length + 1
            yield length


def _resolve(window: int):
    def hashed(part: int, own: list[int], arrays: list[list[np.ndarray]]) -> Iterator[dict]:
        keys, grams, ids = (np.concatenate(x) for x in zip(*arrays, strict=True))
        order = np.lexsort((grams, keys))
        start = np.unique(np.concatenate((C.runs(keys[order]), C.runs(grams[order]))))
        first = np.minimum.reduceat(ids[order], start)
        out = np.empty(len(keys), np.uint8)
        out[order] = ids[order] > C.spread(first, start, len(keys))
        bounds = np.cumsum([0, *(len(a[0]) for a in arrays)])
        yield {"block": own, "kind": [1] * len(own), "part": [part] * len(own), "blob": [C.pack(out[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]}

    def streamed(part: int, own: list[int], arrays: list[list[np.ndarray]]) -> Iterator[dict]:
        origin = np.repeat(np.arange(len(own)), [len(a[0]) for a in arrays])
        gram, ids, first, size = (np.concatenate([a[k] for a in arrays]) for k in range(4))
        words = np.concatenate([a[4] for a in arrays])
        end = np.cumsum(size, dtype=np.int64)
        answer = np.zeros(int(np.sum(size.astype(np.int64) - window + 1)), np.uint8)
        to = np.cumsum(size.astype(np.int64) - window + 1) - (size.astype(np.int64) - window + 1)
        order = np.lexsort((first, ids, gram))
        automaton, group = Automaton(), None
        for x in order:
            if gram[x] != group:
                automaton, group = Automaton(), gram[x]
            sequence = words[end[x] - size[x] : end[x]].tolist()
            for k, length in enumerate(automaton.matching(sequence)):
                if length >= window:
                    answer[to[x] + k - window + 1] = 1
            automaton.add(sequence)
        bounds = np.searchsorted(origin, np.arange(len(own) + 1))
        to = np.append(to, len(answer))
        yield {"block": own, "kind": [2] * len(own), "part": [part] * len(own), "blob": [C.pack(answer[to[a] : to[b]]) for a, b in zip(bounds, bounds[1:], strict=False)]}

    return lambda part, own, arrays: (streamed if part % 2 else hashed)(part, own, arrays)


def _merged(first: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that these stretches cover, each within its document."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    doc = np.searchsorted(offsets, first, side="right")
    start = np.flatnonzero(np.concatenate((np.ones(len(first[:1]), bool), (first[1:] > reach[:-1]) | (doc[1:] != doc[:-1]))))
    return first[start], reach[np.append(start[1:], len(first)) - 1] if len(start) else reach


def _stretches(at: np.ndarray, a: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """First and last of windows that start one after another in a document."""
    stands = np.zeros(int(a.offsets[-1]), bool)
    stands[at] = True
    at = np.flatnonzero(stands)
    fresh = np.concatenate((np.ones(len(at[:1]), bool), at[1:] != at[:-1] + 1))
    of_doc = np.searchsorted(at, a.offsets)
    fresh[of_doc[of_doc < len(at)]] = True
    start = np.flatnonzero(fresh)
    return at[start], at[np.append(start[1:], len(at)) - 1] if len(start) else at


def _covered(a: Anchors, got: dict, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of symbols, each within a document, that stand in windows that occur earlier: start and end.

    Runs and not a mark for each symbol, as counts along all symbols of a block would take
    some tens of bytes for each byte of text.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if len(a.keys):
        codes = C.codes(got, 0, len(a.keys), np.uint8)
        code, lead = a.coded(codes), a.lead[a.of_class]
        later = np.arange(len(code)) != lead if within else a.ids[a.doc] > a.ids[a.doc[lead]]
        whole = (code == LATER) | later
        del code, lead, later
        found.append((a.first[whole], a.last[whole]))
        for kind in (OPEN, HOT):
            chosen = a.leaders(codes, kind, kind == HOT and not within)
            if not len(chosen):
                continue
            if kind == HOT:
                at, hashes, own = a.windows(chosen)
                order, start = _distinct(hashes)
                del hashes
                told = C.spread(C.codes(got, 1, len(start), np.uint8), start, len(order))
                if within:
                    told[np.setdiff1d(np.arange(len(order)), start)] = 1
                else:
                    ids = a.ids[a.doc[own[order]]]
                    told |= ids > C.spread(ids[start], start, len(order))
                    del ids
                at = at[order[told > 0]]
                del own, order, told
            else:
                chosen = chosen[np.argsort(a.gram[chosen], kind="stable")]
                at = C.ranges(a.first[chosen], a.last[chosen] + 1)
                at = at[C.codes(got, 2, len(at), np.uint8) > 0]
            found.append(_stretches(at, a))
            del at
    first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    return _merged(first, last + a.window, a.offsets)


def repeated(docs: DataFrame, unit: str, window: int, gram: int, within: bool, automata: bool, most: int = 4096, keep: bool = False, carry: list[str] | None = None) -> DataFrame:
    """What to remove of each document so that each window of ``window`` symbols stays where it occurs first.

    ``unit``: "bytes" of the UTF-8 text, or "words".  ``within``: an earlier start in
    the same document counts too; otherwise only a smaller doc_id does.  ``most``:
    anchors with more contexts than this go by window, not through an automaton.
    With ``keep`` the remaining text follows (whole UTF-8 characters; null if it was
    null), with ``carry`` a struct ``rest`` of these columns.

    A null text is empty; a null doc_id comes after every other; rows that share
    a doc_id are not earlier than one another across blocks.
    """
    packed = C.blocks(docs, BLOCK, carry)
    x = C.exchange_for(packed)
    answers = C.gathered(C.each_block(packed, _first_pass(unit, window, gram, x), C.EVENTS, C.ARROW_EVENTS), _decide(automata, most), x, (C.Lane(int(SHORT)),))
    answers = C.checkpointed(answers)
    open_ = C.answered(packed, answers, _second_pass(unit, window, gram, x, within), C.EVENTS)
    lanes = C.Lane(8), C.Lane(ragged=True, answers=lambda arrays: int(np.sum(arrays[3].astype(np.int64) - window + 1)))
    answers = answers.unionByName(C.gathered(open_, _resolve(window), x, lanes))
    names = ["doc_id", "n_symbols", "n_removed", "n_spans", "kept_sha256", *(["kept"] * keep)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string()] * keep)]

    def work(block: int, rows: pa.Table, got: dict) -> pa.Table:
        a = Anchors(rows, unit, window, gram)
        start, end = _covered(a, got, within)
        off, data, at = a.offsets, memoryview(a.data), a.byte_offsets.tolist()
        del a
        runs = np.searchsorted(start, off)
        total = np.concatenate(([0], np.cumsum(end - start)))[runs]
        digests, kept = [], []
        for k, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            some = slice(runs[k], runs[k + 1])
            stays = zip([lo, *end[some].tolist()], [*start[some].tolist(), hi], strict=True)
            if unit == "words":
                words = bytes(data[at[k] : at[k + 1]]).split()
                left = b" ".join(chain.from_iterable(words[x - lo : y - lo] for x, y in stays))
            else:
                left = b"".join(data[x:y] for x, y in stays)
            digests.append(hashlib.sha256(left).hexdigest())
            if keep:
                kept.append(left.decode("utf-8", "ignore"))
        if keep:
            kept = [None if x else k for x, k in zip(rows["text"].is_null().to_pylist(), kept, strict=True)]
        cols = [rows["doc_id"], np.diff(off), np.diff(total), np.diff(runs), digests, *([kept] * keep)]
        out = pa.Table.from_arrays([pa.array(x, t) if not isinstance(x, pa.ChunkedArray) else x.combine_chunks() for x, t in zip(cols, kinds, strict=True)], names=names)
        return out.append_column("rest", rows["rest"]) if carry else out

    schema = T.StructType.fromDDL("doc_id long, n_symbols long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep)
    if carry:
        schema = schema.add("rest", T.StructType([docs.schema[c] for c in carry]))
    return C.answered(packed, answers, work, schema)


def suffix_array_dedup(docs: DataFrame, window: int = 50, gram: int = 20, keep: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Depth-limited radix sort over bytes: windows of ``window`` bytes that start in a smaller doc_id go."""
    return repeated(docs, "bytes", window, gram, within=False, automata=False, keep=keep, carry=carry).withColumnRenamed("n_symbols", "n_bytes")


def substring_dedup(docs: DataFrame, window: int = 20, gram: int = 8, most: int = 4096, keep: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Suffix automata over words: windows of ``window`` words that start earlier go.

    One automaton of the whole corpus has no bounded size and cannot be broadcast.
    The reference is sharded by anchor instead: what can match an anchor's windows
    is streamed through the automaton of the earlier spans of that anchor.
    """
    return repeated(docs, "words", window, gram, within=True, automata=True, most=most, keep=keep, carry=carry).withColumnRenamed("n_symbols", "n_words").drop("n_spans")


def without_repeats(docs: DataFrame, window: int = 50, gram: int = 20) -> DataFrame:
    """The documents (columns of ``docs``) with what is left of their texts; those of which nothing is left go.

    ``n_chars``, where there is one, is counted anew for texts that changed.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = suffix_array_dedup(docs, window, gram, keep=True, carry=rest).where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    same = F.col("n_removed") == 0
    names = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    names |= {c: F.when(same, F.col(f"rest.`{c}`")).otherwise(F.length("kept")) if c == "n_chars" else F.col(f"rest.`{c}`") for c in rest}
    return found.select(*(names[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
