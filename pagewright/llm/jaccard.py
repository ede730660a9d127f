"""N-gram Jaccard join by parity sketches.

A document is its set of word shingles.  The sketch of a set has 64-bit words;
each shingle is hashed to one word and XORed into it.  A shingle that only one of
two sets has changes one word, so the number of differing words is at most the
symmetric difference.  Sets are dealt to bands by size.  A band's sketches have
more words than two similar sets can differ in, so by the pigeonhole principle
linked sets share a word: they meet in its bucket.  (Words in which a shingle
flips a single bit made nearly all documents meet: of words that hold one
shingle there are only 64.)  Some words more than that are made, so that words of
one or two shingles, in which common phrases would meet, can be left out except
for sets that have too many of them.

Equal sets are one vertex.  Each block asks for a bucket once, is told its least
vertex (the leader) and sends its members there; pairs among a leader's members
are compared, first by the Hamming distance of sketches in which each shingle
flips one bit, then exactly.  Large groups are cut into chunks.  Only spanning
links come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C
from .components import components

SPARE = 15  # percent of a sketch's words beyond the pigeonhole bound
MOST_BITS = 1 << 16
BLOCK = 8 << 20
ROWS = 20  # bits of a document's row in its block
HEAVY, ROOM, SALTS = 512, 1 << 21, 16  # a larger group (documents; shingles of all of them) is cut into chunks
TURN = 1 << 18  # shingles whose sketch words are made at a time
ALL, ACROSS, CONNECTED = 0, 1, 2  # which pairs of a group are compared
SHORT = np.uint64(16)  # bits of a bucket's key that are left out on the way: two buckets in one cost work, not links


class Bands:
    """Size bands such that similar sets are in the same or in neighbouring bands."""

    def __init__(self, percent: int, largest: int):
        self.percent, starts = percent, [1, 2]
        while starts[-1] <= largest:
            starts.append(max(starts[-1] + 1, (starts[-1] - 1) * 100 // percent + 1))
        self.starts = np.array(starts, np.int64)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, n, side="right") - 1

    def top(self, band: np.ndarray) -> np.ndarray:
        return np.append(self.starts[1:], self.starts[-1] * 100 // self.percent + 1)[band] - 1

    def differ(self, band: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of a linked pair whose larger set is in the band."""
        return self.most(self.top(band), self.top(band))

    def shared(self, n: np.ndarray, band: np.ndarray, words: np.ndarray) -> np.ndarray:
        """How many words at least a set of this size shares with each set linked to it in a band."""
        return words - self.most(n, np.minimum(self.top(band), n * 100 // self.percent))

    @property
    def weak(self) -> int:
        """Words of so many shingles or fewer say little; few enough of them for sets to share others too."""
        mean = (100 + self.percent) / (2 * (100 - self.percent)) / (1 + SPARE / 100)
        below, term, k = 0.0, np.exp(-mean), 0
        while (below := below + term) * (1 + SPARE / 100) <= 0.8 * SPARE / 100:
            k += 1
            term *= mean / k
        return max(0, k - 1)

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (100 - self.percent) * (a + b) // (100 + self.percent)


class Sets:
    """The shingle sets of a block's documents: sorted hashes, offsets, and a vertex for each (0: empty)."""

    def __init__(self, rows: pa.Table, width: int):
        data, offsets = C.raw(rows["text"])
        hashes, _, _, before = C.words(data, offsets, lower=True)
        roll, n = C.Rolling(hashes), np.diff(before)
        every = roll.every(width) if len(hashes) >= width else np.zeros(0, np.uint64)
        found = []
        for k in range(len(n)):
            lo, hi = int(before[k]), int(before[k + 1])
            if hi - lo >= width:
                s = np.sort(every[lo : hi - width + 1])
                found.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            else:
                found.append(roll.of(np.array([lo]), np.array([hi])) if hi > lo else every[:0])
        self.n = np.array([len(s) for s in found], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.n)))
        self.hashes = np.concatenate(found) if found else every
        self.vertex = np.zeros(len(n), np.int64)
        some = np.flatnonzero(self.n)
        if len(some):
            sums = np.add.reduceat(C.mix(self.hashes + np.uint64(0x2545F4914F6CDD1D)), self.offsets[some])
            self.vertex[some] = np.maximum(C.mix(sums ^ self.n[some].astype(np.uint64)), np.uint64(1)).view(np.int64)

    def keys(self, which: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
        """Bucket keys of these documents' sketch words, and the document of each."""
        out = []
        for up in (0, 1):
            band = bands.of(self.n[which]) + up
            differ = bands.differ(band)
            docs, band, differ = which[differ > 0], band[differ > 0], differ[differ > 0]
            words = differ + differ * SPARE // 100 + 3
            first = np.concatenate(([0], np.cumsum(words)))
            tokens = C.ranges(self.offsets[docs], self.offsets[docs + 1])
            of = np.repeat(np.arange(len(docs)), self.n[docs])
            h = C.mix(self.hashes[tokens] ^ np.uint64(0x7F4A7C15))
            at = first[of] + ((h >> np.uint64(32)) * words[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            sketch = np.zeros(int(first[-1]), np.uint64)
            np.bitwise_xor.at(sketch, at, h)
            own = np.repeat(np.arange(len(docs)), words)
            weak = np.bincount(at, minlength=len(sketch)) <= bands.weak
            # all words that a linked pair shares may be weak only where each of the two has as many weak ones
            keep = ~weak | (np.bincount(own[weak], minlength=len(docs)) >= bands.shared(self.n[docs], band, words))[own]
            place = (np.arange(len(own)) - first[own]).astype(np.uint64)
            key = C.mix(C.mix(sketch + band[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + place)
            out.append((key[keep], docs[own[keep]]))
        return np.concatenate([k for k, _ in out]), np.concatenate([d for _, d in out])


class Buckets:
    """The distinct bucket keys of a block, ascending, and the vertices in each."""

    def __init__(self, s: Sets, bands: Bands):
        which = np.unique(s.vertex, return_index=True)[1]
        which = np.sort(which[s.n[which] > 0])
        turns = np.split(which, np.flatnonzero(np.diff(np.cumsum(s.n[which]) // TURN)) + 1)
        found = [(k >> SHORT, s.vertex[d]) for k, d in (s.keys(w, bands) for w in turns)]
        keys, vertex = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        order = np.lexsort((vertex, keys))
        self.keys, self.vertex = keys[order], vertex[order]
        self.start = C.runs(self.keys)

    def events(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, least vertex, and whether there are others."""
        return self.keys[self.start], self.vertex[self.start], (np.diff(np.append(self.start, len(self.keys))) > 1).astype(np.uint8)

    def pairs(self, leaders: np.ndarray) -> np.ndarray:
        """(leader, member) rows, given each key's least vertex of all blocks (0: nobody meets there)."""
        lead = C.spread(leaders, self.start, len(self.keys))
        keep = (lead != 0) & (lead != self.vertex)
        return np.unique(np.stack((lead[keep], self.vertex[keep]), axis=1), axis=0)


def _lead(part: int, own: list[int], arrays: list[list[np.ndarray]]) -> Iterator[dict]:
    """Of each bucket with two vertices or more, the least; a block sends a bucket once, however many of its documents
    are in it."""
    keys, vertex, more = (np.concatenate(x) for x in zip(*arrays, strict=True))
    order = np.lexsort((vertex, keys))
    start = C.runs(keys[order])
    met = np.maximum.reduceat(vertex[order], start) != vertex[order][start]
    met |= np.maximum.reduceat(more[order], start) > 0
    out = np.empty(len(keys), np.int64)
    out[order] = C.spread(np.where(met, vertex[order][start], 0), start, len(keys))
    bounds = np.cumsum([0, *(len(a[0]) for a in arrays)])
    yield {"block": own, "kind": [0] * len(own), "part": [part] * len(own), "blob": [C.pack(out[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]}


def sketches(s: Sets, bits: int) -> list[bytes]:
    """Of each document: a power of two of bits, so many for each shingle or more; each shingle flips one."""
    widths = np.clip(2 ** np.ceil(np.log2(np.maximum(bits * s.n, 1))).astype(np.int64), 256, MOST_BITS) // 64
    first = np.concatenate(([0], np.cumsum(widths)))
    doc, h = np.repeat(np.arange(len(s.n)), s.n), C.mix(s.hashes)
    out = np.zeros(int(first[-1]), np.uint64)
    np.bitwise_xor.at(out, first[doc] + ((h >> np.uint64(6)).astype(np.int64) & (widths[doc] - 1)), np.uint64(1) << (h & np.uint64(63)))
    return [out[lo:hi].tobytes() for lo, hi in zip(first[:-1], first[1:], strict=True)]


def folded(words: list[np.ndarray], width: int) -> np.ndarray:
    """Sketches brought to one width; shorter ones, which stay apart, as zeros."""
    out = np.zeros((len(words), width), np.uint64)
    for k, x in enumerate(words):
        if len(x) >= width:
            out[k] = np.bitwise_xor.reduce(x.reshape(-1, width), axis=0)
    return out


def spanning(words: list[np.ndarray], size: np.ndarray, side: np.ndarray, kind: int, bands: Bands, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sketches differ in few enough bits and, given sets, whose sets do.

    ``kind``: ALL pairs, those ACROSS sides, or those across where the members of
    side False are CONNECTED already.  Pairs that are connected are not compared.
    """
    n, out, same = len(words), [], kind == ALL
    label, width = np.arange(n), np.array([len(x) for x in words])
    if kind == CONNECTED and not side.all():
        label[~side] = np.flatnonzero(~side)[0]
    at = {int(w): folded(words, int(w)) for w in np.unique(width)}
    for a in range(n - 1):
        other = a + 1 + np.flatnonzero(label[a + 1 :] != label[a])
        if not same:
            other = other[side[other] != side[a]]
        most, far = bands.most(size[a], size[other]), np.abs(size[other] - size[a])
        other, most, far = other[far <= most], most[far <= most], far[far <= most]
        shared = np.minimum(width[other], width[a])
        for w in np.unique(shared).tolist():
            some = shared == w
            far[some] = np.maximum(far[some], np.bitwise_count(at[w][other[some]] ^ at[w][a]).sum(axis=1, dtype=np.int64))
        near = np.flatnonzero(far <= most)
        for x in near[np.argsort(far[near], kind="stable")].tolist():
            b = int(other[x])
            if label[a] == label[b]:
                continue
            if sets is not None:
                both = np.concatenate((sets[a], sets[b]))
                both.sort()
                if len(both) - 2 * int(np.count_nonzero(both[1:] == both[:-1])) > most[x]:
                    continue
            label[label == label[b]] = label[a]
            out.append((a, b))
    return out


def similar(docs: DataFrame, width: int = 5, percent: int = 80, heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when their sets of ``width``-word shingles (A-Z in lower case)
    have 100 * intersection >= percent * union; a shorter text is one shingle of
    all its words.  Null and wordless texts link with nothing.  component_id is the
    smallest doc_id reachable; null ids come after every other.  Sets are told
    apart by 64-bit hashes, and so are shingles.
    """
    rooted = _rooted(C.blocks(docs, BLOCK), width, percent, heavy)
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return _dealt(rooted, least, "root").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def _dealt(documents: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Documents (by ``place``) with what is known of some keys; the rows of one key go to many tasks."""
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return documents.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS))).join(salted, [key, "salt"], "left").drop("salt")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, heavy: int = HEAVY) -> DataFrame:
    """The rows of ``docs``, one of each group of similar documents: that with the smallest doc_id, null ids last.

    Rows that repeat are a group; texts without words are none and stay.  Rows are
    told apart by their place in a block, so that neither texts nor ids are joined.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = C.blocks(docs, BLOCK, rest)
    rooted = _rooted(packed, width, percent, heavy)
    first = rooted.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place")).alias("f")).select("f.place")
    stays = first.unionByName(rooted.where("root is null").select("place")).select(F.shiftright("place", ROWS).alias("block"), F.col("place").bitwiseAND((1 << ROWS) - 1).alias("row"))
    schema = T.StructType.fromDDL("doc_id long, text string")
    if rest:
        schema = schema.add("rest", T.StructType([docs.schema[c] for c in rest]))

    def keep(key, left, right):
        rows = C.thawed(left["blob"][0].as_buffer()) if left.num_rows else None
        if rows is None:
            return pa.Table.from_batches([], schema=to_arrow_schema(schema))
        return rows.take(pa.array(np.sort(right["row"].to_numpy())))

    kept = packed.groupBy("block").cogroup(stays.groupBy("block")).applyInArrow(keep, schema)
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(f"rest.`{c}`") for c in rest}
    return kept.select(*(own[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def _rooted(packed: DataFrame, width: int, percent: int, heavy: int) -> DataFrame:
    """Each document's place, id, number of shingles and the vertex that stands for its component (null: no words)."""
    x = C.exchange_for(packed)

    def describe(block: int, rows: pa.Table) -> Iterator[dict]:
        s = Sets(rows, width)
        yield {"place": np.int64(block) << ROWS | np.arange(len(s.n)), "doc_id": rows["doc_id"].to_pylist(), "n_shingles": s.n, "vertex": s.vertex, "coarse": sketches(s, 1), "sketch": sketches(s, 2)}

    schema = "place long, doc_id long, n_shingles long, vertex long, coarse binary, sketch binary"
    arrow = pa.schema([*((x.split()[0], pa.int64()) for x in schema.split(", ")[:-2]), ("coarse", pa.binary()), ("sketch", pa.binary())])
    about = C.checkpointed(C.each_block(packed, describe, schema, arrow))
    largest = about.agg(F.max("n_shingles")).first()[0] or 1
    bands = Bands(percent, int(largest))

    def emit(block: int, rows: pa.Table) -> Iterator[dict]:
        events = Buckets(Sets(rows, width), bands).events()
        bounds = x.cut(events[0] << SHORT)
        full = np.flatnonzero(np.diff(bounds)).tolist()
        yield {"part": full, "block": [block] * len(full), "blob": [C.pack(*(c[bounds[p] : bounds[p + 1]] for c in events), ascending=1) for p in full]}

    def meet(block: int, rows: pa.Table, got: dict) -> pa.Table:
        b = Buckets(Sets(rows, width), bands)
        pairs = b.pairs(C.codes(got, 0, len(b.start), np.int64))
        return pa.table({"leader": pairs[:, 0].copy(), "member": pairs[:, 1].copy()})

    leaders = C.gathered(C.each_block(packed, emit, C.EVENTS, C.ARROW_EVENTS), _lead, x, (C.Lane(int(SHORT)),))
    pairs = C.checkpointed(C.answered(packed, leaders, meet, "leader long, member long").distinct())
    groups = pairs.select(F.col("leader").alias("group"), F.col("member").alias("vertex")).unionByName(pairs.select(F.col("leader").alias("group"), F.col("leader").alias("vertex")).distinct())
    vertices = about.where("vertex <> 0").groupBy("vertex").agg(F.min("place").alias("place"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("coarse").alias("coarse"))
    sizes = vertices.select("vertex", "n")
    near = components(_linked(C.checkpointed(groups.join(sizes, "vertex")), vertices.select("vertex", F.col("coarse").alias("sketch")), bands, heavy, x.parts))
    near = C.checkpointed(near.select(F.col("component").alias("group"), F.col("id").alias("vertex")).join(vertices.drop("coarse"), "vertex"))
    sets = _sets(packed, near.select("vertex", F.shiftright("place", ROWS).alias("block")), width)
    links = _linked(near.select("group", "vertex", "n"), near.select("vertex", "sketch").join(sets, "vertex"), bands, heavy, x.parts)
    joined = components(links).withColumnRenamed("id", "vertex")
    return _dealt(about.select("place", "doc_id", "n_shingles", "vertex"), joined, "vertex").select("place", "doc_id", "n_shingles", F.when(F.col("vertex") != 0, F.coalesce("component", "vertex")).alias("root"))


def _sets(packed: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(vertex, s): the sets of these vertices, each from the block where it stands first."""

    def fetch(key, left, right):
        vertices, out = right["vertex"].to_numpy(), ([], [])
        if left.num_rows and len(vertices):
            s = Sets(C.thawed(left["blob"][0].as_buffer()), width)
            vertex, first = np.unique(s.vertex, return_index=True)
            for k in first[np.isin(vertex, vertices)]:
                out[0].append(int(s.vertex[k]))
                out[1].append(C.pack(s.hashes[s.offsets[k] : s.offsets[k + 1]], ascending=1))
        C.release()
        return pa.table({"vertex": pa.array(out[0], pa.int64()), "s": pa.array(out[1], pa.binary())})

    return packed.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(fetch, "vertex long, s binary")


def _by_group(rows: DataFrame, of_group: DataFrame) -> DataFrame:
    """Rows (group, vertex, ...) with what is known of their group, by an equi-join that deals a large group's rows out."""
    salted = of_group.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("vertex"), F.lit(SALTS))).join(salted, ["group", "salt"]).drop("salt")


def _linked(keys: DataFrame, about: DataFrame, bands: Bands, heavy: int, parts: int) -> DataFrame:
    """Spanning links (a, b) in each group of (group, vertex, n); ``about`` has each vertex's sketch and, for exact ones, set.

    A group is named by its least vertex.  Of a group with more than ``heavy``
    members (or ``ROOM`` shingles) each chunk is first compared with that vertex.
    The rest, which isn't linked with it, is then compared with itself, in pairs of
    chunks, and with those that are, of which it needs one link only.  So a large
    group of near copies costs about its size, and no task holds all of it.
    """
    own = ["n", *(c for c in about.columns if c != "vertex")]
    room = heavy * (ROOM // HEAVY)
    cut = F.greatest(F.ceil(F.count("*") / heavy), F.ceil(F.sum("n") / room))
    large = C.checkpointed(keys.groupBy("group").agg(cut.alias("chunks")).where("chunks > 1"))
    pair = lambda kind, a, b: F.xxhash64("group", F.lit(kind), a, b).alias("pair")
    deal = lambda df, kind, key, side: df.select(key, F.lit(kind).alias("kind"), side.alias("side"), "vertex", *own)
    whole = lambda df: deal(df.join(about, "vertex"), ALL, F.xxhash64("group").alias("pair"), F.lit(False))
    if large.isEmpty():
        return _compared(whole(keys), bands, parts)
    small = keys.join(large, "group", "left_anti")
    of_vertex = F.pmod(F.xxhash64("vertex"), F.lit(1 << 40))
    crowd = C.checkpointed(_by_group(keys, large).join(about, "vertex"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    star = pair(ACROSS, F.col("chunk"), F.lit(0))
    first = crowd.where("vertex = group").withColumn("chunk", every(F.col("chunks")))
    others = crowd.where("vertex <> group").withColumn("chunk", of_vertex % F.col("chunks"))
    found = C.checkpointed(_compared(whole(small).unionByName(deal(first, ACROSS, star, F.lit(True))).unionByName(deal(others, ACROSS, star, F.lit(False))), bands, parts))

    linked = found.select(F.least("a", "b").alias("group"), F.greatest("a", "b").alias("vertex"))
    names = crowd.select("group", "vertex", "n").where("vertex <> group")
    rest = C.checkpointed(names.join(linked, ["group", "vertex"], "left_anti"))
    if rest.isEmpty():
        return found
    of_rest = C.checkpointed(rest.groupBy("group").agg(cut.alias("of_rest")))
    core = names.join(linked, ["group", "vertex"], "left_semi")
    of_core = core.groupBy("group").agg(cut.alias("of_core"))
    # members with the number of chunks of their own side and of the other
    told = of_rest.join(of_core, "group", "left").withColumn("of_core", F.coalesce("of_core", F.lit(0)))
    rest = _by_group(rest, told).withColumn("chunk", of_vertex % F.col("of_rest")).select("group", "vertex", "chunk", "of_rest", "of_core")
    core = _by_group(core, told).withColumn("chunk", of_vertex % F.col("of_core")).select("group", "vertex", "chunk", "of_rest", "of_core")
    payload = crowd.select("vertex", *own).dropDuplicates(["vertex"])
    turns = rest.withColumn("other", every(F.col("of_rest")))
    same = F.when(F.col("chunk") == F.col("other"), ALL).otherwise(ACROSS)
    within = turns.select(F.xxhash64("group", F.lit("rest"), F.least("chunk", "other"), F.greatest("chunk", "other")).alias("pair"), same.alias("kind"), (F.col("chunk") > F.col("other")).alias("side"), "vertex")
    of_rests = rest.where("of_core > 0").withColumn("other", every(F.col("of_core"))).select(pair(CONNECTED, F.col("other"), F.col("chunk")), F.lit(CONNECTED).alias("kind"), F.lit(True).alias("side"), "vertex")
    of_cores = core.withColumn("other", every(F.col("of_rest"))).select(pair(CONNECTED, F.col("chunk"), F.col("other")), F.lit(CONNECTED).alias("kind"), F.lit(False).alias("side"), "vertex")
    dealt = within.unionByName(of_rests).unionByName(of_cores).join(payload, "vertex")
    return found.unionByName(_compared(dealt, bands, parts)).distinct()


def _compared(dealt: DataFrame, bands: Bands, parts: int) -> DataFrame:
    """Spanning links of each ``pair``, which is one task's work or a piece of it."""
    exact = "s" in dealt.columns

    def compare(table):
        pair, vertex, n, side, kind = (table[c].to_numpy() for c in ("pair", "vertex", "n", "side", "kind"))
        order = np.lexsort((vertex, pair))
        words = [np.frombuffer(w, np.uint64) for w in table["sketch"].to_pylist()]
        blobs, out = table["s"] if exact else None, ([], [])
        start = np.append(C.runs(pair[order]), len(order))
        for lo, hi in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
            if hi - lo > 1:
                at = order[lo:hi]
                own = [C.unpack(blobs[int(k)].as_buffer().to_pybytes())[0] for k in at] if exact else None
                for a, b in spanning([words[k] for k in at], n[at], side[at], int(kind[at[0]]), bands, own):
                    out[0].append(int(vertex[at[a]]))
                    out[1].append(int(vertex[at[b]]))
        C.release()
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("pair"), F.lit(4 * parts)))
    return dealt.groupBy("part").applyInArrow(compare, "a long, b long").distinct()
