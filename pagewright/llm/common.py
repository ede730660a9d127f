"""Shared plumbing: session settings, tables, packed arrays and document blocks.

The heavy text operators move *blocks*, not rows.  A block is one row holding
some megabytes of documents as a compressed Arrow stream; events that must meet
elsewhere travel as packed numpy arrays, one row per (block, part).  Shuffles
then carry few large binary values, Python sees whole arrays, and a task's
memory is bounded by the block and part sizes, whatever the input.
"""

from __future__ import annotations

import ctypes
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed  # noqa: F401  (part of this module's interface)

BLOCK_BYTES = 16 << 20
NULL_ID = np.iinfo(np.int64).max
EVENTS = "part long, block long, blob binary"
ANSWERS = "block long, kind int, part long, blob binary"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, modulus: int):
    """crc32 of the id's text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def crc(value: object) -> int:
    return zlib.crc32(str("" if value is None else value).encode())


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps for its next task of the same kind, until it ends one of another kind."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def release(keep: bool = False) -> None:
    """Give what a Python worker has freed back to the system: workers wait for tasks beside a busy JVM."""
    if not keep:
        _kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# ---------------------------------------------------------------- packed arrays


def pack(*arrays: np.ndarray, ascending: int = 0) -> bytes:
    """Arrays as bytes: byte planes under zstd, the first ``ascending`` ones as differences."""
    press, out = zstandard.ZstdCompressor(level=1), [struct.pack("<B", len(arrays))]
    for k, a in enumerate(arrays):
        a = np.ascontiguousarray(a)
        kind = a.dtype.str.encode().ljust(4)
        if k < ascending and len(a):
            a = np.concatenate((a[:1], a[1:] - a[:-1]))
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        body = press.compress(planes)
        out += [struct.pack("<4sBQQ", kind, k < ascending, len(a), len(body)), body]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    press, at, out = zstandard.ZstdDecompressor(), 1, []
    for _ in range(blob[0]):
        kind, rising, n, size = struct.unpack_from("<4sBQQ", blob, at)
        at += 21
        dtype = np.dtype(kind.decode().strip())
        planes = press.decompress(blob[at : at + size], max_output_size=max(1, n * dtype.itemsize)) if n else b""
        a = np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T.copy().reshape(-1).view(dtype)
        out.append(np.cumsum(a, dtype=dtype) if rising else a)
        at += size
    return out


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))


def spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """One value per run, repeated over the run's rows."""
    return np.repeat(values, np.diff(np.append(starts, n)))


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0]..hi[0]-1, lo[1]..hi[1]-1, ... as one array."""
    n = hi - lo
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(lo - ends + n, n)


# ----------------------------------------------------------------------- hashes

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of any stretches of a symbol array, from prefix sums modulo 2**64."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, n: int) -> np.ndarray:
        """The hash of each stretch of n symbols."""
        m = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:m]) * self.down[:m])


_PLACES = 64


def _of_bytes(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random value for each byte at each place of a word."""
    return mix(mix(place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ BYTE_VALUES[data])


_OF_BYTES = _of_bytes(np.tile(np.arange(256), _PLACES), np.repeat(np.arange(_PLACES), 256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The hash of each word from its start up to the next one's, blanks apart: a sum of values that are independent for
    every byte and place, so that no pattern within words makes two of them alike."""
    place = np.arange(len(data)) - spread(start, start, len(data))
    values = _OF_BYTES[np.minimum(place, _PLACES - 1) << 8 | data]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        values[far] = _of_bytes(data[far], place[far])
    values[_SPACE[data]] = 0
    return mix(np.add.reduceat(values, start))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word ``[^\\x20\\x09-\\x0D]+``, and how many words precede each document."""
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    begin = inside[1:-1] & ~inside[:-2]
    begin[inner] |= inside[1:-1][inner]
    stop = inside[1:-1] & ~inside[2:]
    inner = inner[inner > 0]
    stop[inner - 1] |= inside[1:-1][inner - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    hashes = np.zeros(len(start), np.uint64)
    step = 1 << 20
    at = 0
    while at < len(start):  # in pieces, as each byte takes some tens of bytes here
        upto = max(at + 1, int(np.searchsorted(start, start[at] + step)))
        lo, hi = start[at], end[upto - 1]
        hashes[at:upto] = word_hashes(data[lo:hi], start[at:upto] - lo)
        at = upto
    return hashes, start, end, np.searchsorted(start, offsets)


# ----------------------------------------------------------------------- blocks


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and each row's offset; null is empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def frozen(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def thawed(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Documents (doc_id, text, and a struct ``rest`` of the columns to carry) as rows (block, blob), checkpointed.

    Rows keep their input partition, so no text is shuffled; in a block they are
    ordered by doc_id (null last).  The checkpoint fixes the blocks, so that a
    recomputed task meets the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, serial, pid = [], 0, 0, TaskContext.get().partitionId()
        release()  # before the first batch is held, of what tasks of another kind have kept

        def flush() -> pa.RecordBatch:
            nonlocal held, size, serial
            rows = pa.Table.from_batches(held)
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
            out = pa.RecordBatch.from_arrays([pa.array([pid << 16 | serial]), pa.array([frozen(rows)], pa.binary())], names=["block", "blob"])
            held, size, serial = [], 0, serial + 1
            return out

        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
            at = 0
            while at < batch.num_rows:
                upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + block_bytes - size)) + 1
                upto = min(upto, batch.num_rows)
                held.append(batch.slice(at, upto - at))
                size += int(sizes[upto - 1] - (sizes[at - 1] if at else 0))
                at = upto
                if size >= block_bytes:
                    yield flush()
        if held:
            yield flush()
        release()

    rest = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("rest")] if carry else []
    return checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest).mapInArrow(run, "block long, blob binary"))


def ids(rows: pa.Table) -> np.ndarray:
    return pc.fill_null(rows["doc_id"], NULL_ID).to_numpy()


def each_block(packed: DataFrame, work: Callable[[int, pa.Table], Iterator[dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    """``work(block, documents)`` for each block; it yields columns of lists or arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch["block"], batch["blob"], strict=True):
                for out in work(block.as_py(), thawed(blob.as_buffer())):
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
                release()

    return packed.mapInArrow(run, schema)


ARROW_EVENTS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("blob", pa.binary())])
ARROW_ANSWERS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("blob", pa.binary())])


@dataclass(frozen=True)
class Exchange:
    """The way of events from blocks to parts, and of answers back.

    Up to ``FAN`` blocks each of them writes to each part.  Beyond, that would be a
    blob of a few keys for each pair of a block and a part.  So blocks write to the
    square root of their number of *ranges*, a range's blobs of about as many blocks
    (a *team*) are joined and cut into its parts, and answers go back the same way:
    blobs grow with the power 1.5 of the input, and stay of one size.
    """

    parts: int
    spans: int = 1  # parts of a range
    teams: int = 1

    @property
    def ranges(self) -> int:
        return self.parts // self.spans

    def cut(self, ordered: np.ndarray) -> np.ndarray:
        """Bounds of the ranges within ascending, evenly spread 64-bit hashes."""
        steps = [(r * self.spans << 64) // self.parts for r in range(1, self.ranges)]
        return np.concatenate(([0], np.searchsorted(ordered, np.array(steps, np.uint64)), [len(ordered)])).astype(np.int64)


#: Up to here (some 35 GB of documents) a part's blobs of a block hold about 600 bytes or more, four times their frame.
FAN = 8192
#: Blocks from here on are of a kind of their own; no team holds both kinds.
MARKED = 1 << 50


def exchange_for(packed: DataFrame) -> Exchange:
    """As many parts as blocks: both sides of the exchange keep a bounded size."""
    n = max(8, packed.select("block").count())
    if n <= FAN:
        return Exchange(n)
    side = isqrt(n - 1) + 1
    return Exchange(side * side, side, side)


@dataclass(frozen=True)
class Lane:
    """Events of one kind: how far their keys (the first array, ascending) are shifted, whether the last array holds as
    many items for each event as the one before it says, and how many answers some events get."""

    shift: int = 0
    ragged: bool = False
    answers: Callable[[list[np.ndarray]], int] = lambda arrays: len(arrays[0])

    def split(self, arrays: list[np.ndarray], steps: np.ndarray) -> list[list[np.ndarray]]:
        at = np.concatenate(([0], np.searchsorted(arrays[0] << np.uint64(self.shift), steps), [len(arrays[0])]))
        to = np.concatenate(([0], np.cumsum(arrays[-2], dtype=np.int64)))[at] if self.ragged else at
        flat = arrays[:-1] if self.ragged else arrays
        return [[*(x[at[k] : at[k + 1]] for x in flat), *([arrays[-1][to[k] : to[k + 1]]] if self.ragged else [])] for k in range(len(at) - 1)]


Work = Callable[[int, list[int], list[list[np.ndarray]]], Iterator[dict]]


def gathered(events: DataFrame, work: Work, x: Exchange, lanes: tuple[Lane, ...] = (Lane(),)) -> DataFrame:
    """All events of a part meet: ``work(part, blocks, arrays of each block)`` yields answers.

    ``part`` is the range (the part, where a range has only one) times the number
    of lanes, plus the lane.  Of several parts a range, ``blocks`` are teams.
    Answers follow the events' order; those to block -1 are for no block.
    """
    if x.spans == 1:
        return _met(events, work)
    n = len(lanes)
    team = F.when(F.col("block") >= MARKED, F.lit(MARKED)).otherwise(F.lit(0)) + F.pmod(F.xxhash64("block"), F.lit(x.teams))

    def join(key, rows):
        code, own = key[0].as_py(), key[1].as_py()
        r, lane = divmod(code, n)
        steps = np.array([((r * x.spans + k) << 64) // x.parts for k in range(1, x.spans)], np.uint64)
        rows = rows.sort_by("block")
        cut = [lanes[lane].split(unpack(b.as_buffer().to_pybytes()), steps) for b in rows["blob"]]
        out = {"listed": [True], "part": [code], "block": [own], "blob": [pack(rows["block"].to_numpy(), np.array([[lanes[lane].answers(c) for c in own_] for own_ in cut], np.int64).reshape(-1))]}
        for k in range(x.spans):
            arrays = [np.concatenate(c) for c in zip(*(own_[k] for own_ in cut), strict=True)]
            if len(arrays[0]):
                for name, value in zip(out, (False, n * (r * x.spans + k) + lane, own, pack(*arrays, ascending=1)), strict=True):
                    out[name].append(value)
        release()
        return pa.table(out, schema=pa.schema([("listed", pa.bool_()), *ARROW_EVENTS]))

    joined = checkpointed(events.withColumn("team", team).groupBy("part", "team").applyInArrow(join, f"listed boolean, {EVENTS}"))
    answers = checkpointed(_met(joined.where("NOT listed").drop("listed"), work))
    place = F.floor(F.col("part") / n)
    code = (F.floor(place / x.spans) * n + F.pmod(F.col("part"), F.lit(n))).alias("code")

    def back(key, left, right):
        blocks, sizes = unpack(left["blob"][0].as_buffer().to_pybytes())
        edges = np.vstack((np.zeros(x.spans, np.int64), np.cumsum(sizes.reshape(len(blocks), x.spans), axis=0)))
        out = ([], [], [], [])
        right = right.sort_by([("kind", "ascending"), ("part", "ascending")])
        kinds, places = right["kind"].to_numpy(), right["part"].to_numpy() // n % x.spans
        for kind in np.unique(kinds):
            at = np.flatnonzero(kinds == kind)
            told = [unpack(right["blob"][int(k)].as_buffer().to_pybytes())[0] for k in at]
            for b, block in enumerate(blocks.tolist()):
                own = [a[edges[b, k] : edges[b + 1, k]] for a, k in zip(told, places[at], strict=True)]
                if sum(map(len, own)):
                    for column, value in zip(out, (block, int(kind), key[0].as_py(), pack(np.concatenate(own))), strict=True):
                        column.append(value)
        release()
        return pa.table(dict(zip(ARROW_ANSWERS.names, out, strict=True)), schema=ARROW_ANSWERS)

    listed = joined.where("listed").select(F.col("part").alias("code"), "block", "blob").groupBy("code", "block")
    told = answers.where("block >= 0").select("*", code).groupBy("code", "block")
    return listed.cogroup(told).applyInArrow(back, ANSWERS).unionByName(answers.where("block < 0"))


def _met(events: DataFrame, work: Work) -> DataFrame:
    def run(key, rows):
        part, blobs = key[0].as_py(), rows["blob"]
        own = rows["block"].to_pylist()
        out = [pa.RecordBatch.from_pydict(x, schema=ARROW_ANSWERS) for x in work(part, own, [unpack(b.as_buffer().to_pybytes()) for b in blobs])]
        release()
        return pa.Table.from_batches(out, schema=ARROW_ANSWERS)

    return events.groupBy("part").applyInArrow(run, ANSWERS)


def codes(got: dict[int, list[tuple[int, bytes]]], kind: int, n: int, dtype: type) -> np.ndarray:
    """A block's answers of one kind, in the order of its ``n`` events."""
    found = [unpack(blob)[0] for _, blob in got.get(kind, [])]
    out = np.concatenate(found) if found else np.zeros(0, dtype)
    if len(out) != n:
        raise RuntimeError(f"{len(out)} answers to {n} events")
    return out


def answered(packed: DataFrame, answers: DataFrame, work: Callable[[int, pa.Table, dict[int, list[tuple[int, bytes]]]], pa.Table], schema: str) -> DataFrame:
    """Each block again, with the answers to it: ``work(block, documents, {kind: [(part, blob), ...]})``."""

    def run(key, left, right):
        got: dict[int, list[tuple[int, bytes]]] = {}
        for kind, part, blob in zip(right["kind"].to_pylist(), right["part"].to_pylist(), right["blob"], strict=True):
            got.setdefault(kind, []).append((part, blob.as_buffer().to_pybytes()))
        for x in got.values():
            x.sort(key=lambda y: y[0])
        out = work(key[0].as_py(), thawed(left["blob"][0].as_buffer()), got)
        release()
        return out

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
