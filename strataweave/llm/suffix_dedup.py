"""Removal of long repeated byte strings by a logarithmic family of suffix arrays.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else as
well. A suffix array of every byte would have more rows than the corpus has bytes,
so arrays hold sampled suffixes: of each window of ``length`` bytes the place where
the hash of the next ``PREFIX`` bytes is least. Equal windows sample the same place,
so nothing is missed, and neighbouring windows mostly share it.

1. Texts arrive in batches of what the cluster's cores sort at once. A batch's
   suffix array has its sampled suffixes in the order of their first eight bytes and
   then of the digest of the first ``PREFIX`` ones, so suffixes with a long common
   prefix stand side by side; it is bucketed, sorted and stored.
2. A new array is merge-scanned against every level of the family, bucket by bucket
   and without a shuffle; common suffixes are hits. Then arrays of equal level merge
   into one of the next, so a suffix is rewritten as often as the logarithm of the
   number of batches.
3. Hits are settled exactly, from coarse to fine, by digests of 128 bits: all windows
   of a sampled place at once (``region``), those of ``BLOCK`` offsets, single windows.
   What occurs twice as a whole is a span; of the rest one representative of each
   different text goes on to the finer step. Groups are only ever counted, in part
   before they are shuffled, so neither thousands of copies nor a passage that a
   third of all documents holds meets in one task, and no pairs are formed.
4. Spans of a document are united and its bytes cut.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .bitmaps import broadcast_bits, held
from .workspace import Workspace

LENGTH = 400
#: Bytes of a sampled suffix that its place in an array is told by.
PREFIX = 128
#: Offsets that the second step settles at once.
BLOCK = 16
#: Windows of one text that are looked at together.
CHUNK = 1 << 20
#: Bytes of text that each core brings to a batch.
BATCH_BYTES = 32 << 20
#: Rows of an array that one bucket holds on average.
BUCKET_ROWS = 262_144
HOT_SHARE = 1000
_PLACE = np.uint64((1 << 21) - 1)
_U = np.uint64


@dataclass(frozen=True)
class Shape:
    """What every pass over the texts must agree on."""

    length: int = LENGTH
    prefix: int = PREFIX
    block: int = BLOCK
    chunk: int = CHUNK


@cache
def _base(seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, the powers of an odd base and those of its inverse modulo 2**64."""
    byte = at.constants(60 + seed, 256) | _U(1)
    base = int(at.constants(70 + seed, 1)[0]) | 5
    ahead, back = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    ahead[0] = back[0] = 1
    return byte, np.multiply.accumulate(ahead), np.multiply.accumulate(back)


class Sums:
    """Digests of any byte range of a chunk from running sums."""

    def __init__(self, raw: np.ndarray, seed: int):
        size = 1 << max(21, int(len(raw)).bit_length())
        byte, ahead, self.back = _base(seed, size)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(byte[raw] * ahead[: len(raw)], out=self.total[1:])

    def digest(self, a: np.ndarray, b: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return at.mix64((self.total[b] - self.total[a]) * self.back[a] + (b - a).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + np.asarray(salt).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))


@dataclass
class Places:
    """Sampled places of a chunk: the windows first..last sample the suffix at ``place``; ``row`` and ``base`` find them in the batch."""

    row: np.ndarray
    base: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    key: np.ndarray

    def take(self, chosen: np.ndarray) -> Places:
        return Places(*(x[chosen] for x in (self.row, self.base, self.first, self.last, self.place, self.key)))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    span = 1
    while span * 2 <= width:
        values, span = np.minimum(values[:-span], values[span:]), span * 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :])


def _sampled(raw: np.ndarray, edges: np.ndarray, sums: Sums, length: int, prefix: int) -> tuple[np.ndarray, ...]:
    """(first, last, place, key) of the windows of a chunk; none crosses the ``edges`` between its texts."""
    windows = len(raw) - length + 1
    at_ = np.arange(len(raw) - prefix + 1)
    keys = at.mix64((sums.total[prefix:] - sums.total[:-prefix]) * sums.back[: len(at_)])
    # Ties of the hash's upper bits go to the first place, so the choice depends on the window's bytes alone.
    least = _least((keys & ~_PLACE) | at_.astype(np.uint64), length - prefix + 1)
    place = (least & _PLACE).astype(np.int64)
    crossing = np.zeros(windows + 1, np.int32)
    inside = edges[(edges > 0) & (edges < len(raw))]
    np.add.at(crossing, np.clip(inside - length + 1, 0, windows), 1)
    np.add.at(crossing, np.clip(inside, 0, windows), -1)
    whole = np.cumsum(crossing[:-1]) == 0
    cut = np.flatnonzero((place[1:] != place[:-1]) | (whole[1:] != whole[:-1])) + 1
    first = np.append(0, cut)
    last = np.append(cut, windows) - 1
    some = whole[first]
    first, last = first[some], last[some]
    return first, last, place[first], keys[place[first]]


def _chunks(batch: pa.RecordBatch, shape: Shape) -> Iterator[tuple[np.ndarray, tuple[Sums, Sums], Places]]:
    """The batch's bytes a chunk at a time: several short texts, or a part of a long one that overlaps the next by a window."""
    length = shape.length
    raw, off = at.utf8(batch.column("text"))
    for a, b in at.slices(off, shape.chunk):
        start, stop = int(off[a]), int(off[b])
        for begin in range(start, max(start + 1, stop - length + 1), shape.chunk):
            piece = raw[begin : min(stop, begin + shape.chunk + length - 1)]
            if len(piece) < length:
                continue
            sums = Sums(piece, 0), Sums(piece, 1)
            edges = off[a : b + 1] - begin
            first, last, place, key = _sampled(piece, edges, sums[0], length, shape.prefix)
            row = np.searchsorted(off, first + begin, side="right") - 1
            yield piece, sums, Places(row, begin - off[row], first, last, place, key)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(at.signed(np.ascontiguousarray(x)))


_REGIONS = "head long, key long, g1 long, g2 long, r1 long, r2 long, at long, n int"


def _regions(shape: Shape):
    """A row for each sampled place: its suffix's first bytes and digest, the digest of all its windows, and where they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r1, r2 = batch.column("r1"), batch.column("r2")
            for raw, (one, two), p in _chunks(batch, shape):
                head = np.zeros(len(p.place), np.int64)
                for k in range(8):
                    head = (head << 8) | (raw[p.place + k] if k < shape.prefix else 0)
                a, b, row = p.first, p.last + shape.length, pa.array(p.row)
                columns = [pa.array(head), _signed(p.key), _signed(one.digest(a, b)), _signed(two.digest(a, b)), r1.take(row), r2.take(row), pa.array(p.first + p.base), pa.array((p.last - p.first + 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["head", "key", "g1", "g2", "r1", "r2", "at", "n"])

    return run


def _chosen(batch: pa.RecordBatch, p: Places, bits) -> Places:
    own = batch.column("r1").to_numpy()
    return p.take(held(bits.value, own[p.row] ^ (p.first + p.base)))


def _cut_blocks(p: Places, block: int) -> tuple[np.ndarray, ...]:
    """Of each place's windows those of ``block`` offsets at a time: (index of the place, number of the block, first window, windows)."""
    low, high = p.place - p.last, p.place - p.first
    count = high // block - low // block + 1
    index = np.repeat(np.arange(len(p.place)), count)
    number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + (low // block)[index]
    most, least = np.minimum(number * block + block - 1, high[index]), np.maximum(number * block, low[index])
    return index, number, p.place[index] - most, most - least + 1


_BLOCKS = "c1 long, c2 long, u1 long, u2 long, r1 long, r2 long, at long, n int"


def _blocks(shape: Shape, bits):
    """A row for each block of a chosen place: the digest of the bytes that all its windows share, that of all their bytes if none is missing, and where they start."""
    length, block = shape.length, shape.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r1, r2 = batch.column("r1"), batch.column("r2")
            for _, (one, two), p in _chunks(batch, shape):
                p = _chosen(batch, p, bits)
                if not len(p.place):
                    continue
                index, number, first, n = _cut_blocks(p, shape.block)
                a = p.place[index] - number * block
                b = a + length - block + 1
                full = n == block
                ua, ub = np.where(full, a - block + 1, a), np.where(full, a + length, a)
                u = [pa.array(at.signed(s.digest(ua, ub, number)), mask=~full) for s in (one, two)]
                row = pa.array(p.row[index])
                columns = [_signed(one.digest(a, b, number)), _signed(two.digest(a, b, number)), *u, r1.take(row), r2.take(row), pa.array(first + p.base[index]), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["c1", "c2", "u1", "u2", "r1", "r2", "at", "n"])

    return run


_WINDOWS = "w1 long, w2 long, r1 long, r2 long, at long, n int"


def _windows(shape: Shape, bits, block_bits):
    """A row for each window of a chosen block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r1, r2 = batch.column("r1"), batch.column("r2")
            own = r1.to_numpy()
            for _, (one, two), p in _chunks(batch, shape):
                p = _chosen(batch, p, bits)
                if not len(p.place):
                    continue
                index, _, first, n = _cut_blocks(p, shape.block)
                some = held(block_bits.value, own[p.row[index]] ^ (first + p.base[index]))
                index, first, n = index[some], first[some], n[some]
                a = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                index = np.repeat(index, n)
                row = pa.array(p.row[index])
                columns = [_signed(one.digest(a, a + shape.length)), _signed(two.digest(a, a + shape.length)), r1.take(row), r2.take(row), pa.array(a + p.base[index]), pa.array(np.ones(len(a), np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "r1", "r2", "at", "n"])

    return run


def _screen(hit, mixed):
    """Regions whose suffix may be a hit, with whether its windows may differ from place to place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            some = held(hit.value, key)
            kept = batch.filter(pa.array(some)).select(["g1", "g2", "r1", "r2", "at", "n"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(held(mixed.value, key[some]))], names=[*kept.schema.names, "mixed"])

    return run


class ArrayFamily:
    """Levels of suffix arrays: rows (head, key, n, low, high), one a suffix, bucketed by and sorted on (head, key).

    ``n`` counts places, ``low`` and ``high`` are the least and greatest region digest at them.
    """

    def __init__(self, work: Workspace, buckets: int):
        self.work, self.buckets = work, buckets
        self.levels: dict[int, tuple[str, DataFrame]] = {}
        self.hits: list[DataFrame] = []
        self.tables: list[str] = []

    def _write(self, rows: DataFrame, *, bucketed: bool) -> tuple[str, DataFrame]:
        name = f"suffixes_{uuid.uuid4().hex}"
        self.tables.append(name)
        placed = rows if bucketed else rows.repartition(self.buckets, "head", "key")
        placed.write.bucketBy(self.buckets, "head", "key").sortBy("head", "key").option("path", f"{self.work.base}/{name}").format("parquet").saveAsTable(name)
        return name, self.work.spark.table(name)

    def _forget(self, name: str) -> None:
        self.work.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.remove(name)
        self.work.drop(name)

    @staticmethod
    def _other(rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(c).alias(f"o_{c}") for c in ("head", "key", "n", "low", "high"))).hint("merge")

    def add(self, regions: DataFrame) -> None:
        """A batch: its array is scanned against every level, then stored; equal levels merge."""
        own = regions.groupBy("head", "key").agg(F.count("*").alias("n"), F.min("g1").alias("low"), F.max("g1").alias("high"))
        name, array = self._write(own, bucketed=False)
        on = (F.col("head") == F.col("o_head")) & (F.col("key") == F.col("o_key"))
        found = [array.where("n > 1").select("head", "key", "low", "high")]
        for _, level in self.levels.values():
            met = array.join(self._other(level), on)
            found.append(met.select("head", "key", F.least("low", "o_low").alias("low"), F.greatest("high", "o_high").alias("high")))
        hits = found[0]
        for more in found[1:]:
            hits = hits.unionByName(more)
        self.hits.append(self.work.keep(hits, f"hits-{len(self.hits)}"))
        level = 0
        while level in self.levels:
            other, rows = self.levels.pop(level)
            joined = array.join(self._other(rows), on, "full_outer")
            merged = joined.select(*(F.coalesce(c, f"o_{c}").alias(c) for c in ("head", "key")), (F.coalesce("n", F.lit(0)) + F.coalesce("o_n", F.lit(0))).alias("n"), F.least("low", "o_low").alias("low"), F.greatest("high", "o_high").alias("high"))
            names = (name, other)
            name, array = self._write(merged, bucketed=True)
            for old in names:
                self._forget(old)
            level += 1
        self.levels[level] = (name, array)

    def found(self) -> DataFrame:
        """(key, mixed): suffixes at two places or more, and whether their regions differ."""
        out = self.hits[0]
        for more in self.hits[1:]:
            out = out.unionByName(more)
        return out.groupBy("head", "key").agg((F.min("low") != F.max("high")).alias("mixed")).select("key", "mixed")

    def drop(self) -> None:
        for name in list(self.tables):
            self._forget(name)


def _spans(units: DataFrame, keys: list[str], work: Workspace, name: str) -> DataFrame:
    """(r1, r2, at, n) of the units whose digest occurs twice or more.

    A digest with more than a thousandth of all units meets them by broadcast, of which there are under a
    thousand; the others grow with the corpus and are merged.
    """
    twice = work.keep(units.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1"), f"{name}-twice")
    hot = F.col("times") * HOT_SHARE > units.count()
    large, others = F.broadcast(twice.where(hot).select(*keys)), twice.where(~hot).select(*keys)
    met = units.join(large, keys).unionByName(units.join(large, keys, "left_anti").join(others.hint("merge"), keys))
    return met.select("r1", "r2", "at", "n")


def _place(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("first.r1").bitwiseXOR(F.col("first.at")).alias("place"))


def repeated_spans(base: DataFrame, work: Workspace, shape: Shape, batches: int) -> DataFrame:
    """(r1, r2, at, n): n windows of the shape's length from ``at`` on start elsewhere too. ``base`` has (r1, r2, text)."""
    regions = base.mapInArrow(_regions(shape), _REGIONS).withColumn("batch", F.pmod(F.spark_partition_id(), F.lit(batches)))
    regions.write.partitionBy("batch").parquet(f"{work.base}/regions")
    regions = work.spark.read.schema(regions.schema).parquet(f"{work.base}/regions")
    family = ArrayFamily(work, max(1, min(1 << 16, regions.count() // BUCKET_ROWS)))
    try:
        for k in range(batches):
            family.add(regions.where(F.col("batch") == k))
        hits = work.keep(family.found(), "found")
    finally:
        family.drop()
    first = lambda: F.min(F.struct("r1", "at")).alias("first")
    screened = regions.drop("batch", "head").mapInArrow(_screen(broadcast_bits(hits, "key"), broadcast_bits(hits.where("mixed"), "key")), "g1 long, g2 long, r1 long, r2 long, at long, n int, mixed boolean")
    screened = work.keep(screened, "screened")
    spans = [_spans(screened.drop("mixed"), ["g1", "g2"], work, "regions")]
    # One place of each different region whose suffix has others as well goes on.
    chosen = broadcast_bits(_place(screened.where("mixed").groupBy("g1", "g2").agg(first())), "place")
    blocks = work.keep(base.mapInArrow(_blocks(shape, chosen), _BLOCKS), "blocks")
    spans.append(_spans(blocks, ["u1", "u2"], work, "blocks"))
    whole = blocks.where("u1 IS NOT NULL").groupBy("c1", "c2", "u1", "u2").agg(first()).select("c1", "c2", "first")
    kinds = work.keep(whole.unionByName(blocks.where("u1 IS NULL").select("c1", "c2", F.struct("r1", "at").alias("first"))), "kinds")
    several = kinds.groupBy("c1", "c2").agg(F.count("*").alias("times")).where("times > 1").select("c1", "c2")
    finer = broadcast_bits(_place(kinds.join(several.hint("merge"), ["c1", "c2"])), "place")
    windows = work.keep(base.mapInArrow(_windows(shape, chosen, finer), _WINDOWS), "windows")
    spans.append(_spans(windows, ["w1", "w2"], work, "windows"))
    return spans[0].unionByName(spans[1]).unionByName(spans[2]).distinct()


def united(found: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs [start, stop) of bytes that windows cover, from (first window, windows)."""
    out: list[list[int]] = []
    for start, n in sorted(found):
        stop = start + n - 1 + length
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(x) for x in out]


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Python texts exist for a slice of rows at a time.
            for batch in (whole.slice(a, 256) for a in range(0, whole.num_rows, 256)):
                rows = []
                for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
                    raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    runs = united([(x["at"], x["n"]) for x in found.as_py() or ()], length)
                    ends = [0, *[e for run in runs for e in run], len(raw)]
                    kept = b"".join([raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]) if runs else raw
                    rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in runs], kept))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, prefix: int = PREFIX, block: int = BLOCK, chunk: int = CHUNK, batch_bytes: int = BATCH_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept: one row per input row.

    Texts count as UTF-8 bytes (null: empty). Every byte goes that a string of
    ``length`` bytes covers which also starts anywhere else, in the same text too;
    strings are judged on the input. ``spans`` are the maximal removed runs [start,
    stop), ``kept`` the remaining bytes, which may part a character. Rows that repeat
    an id or a whole row are repeats of each other like any texts; ids may be of any
    type and null. Shorter texts lose nothing, long ones are read in overlapping parts,
    other columns are ignored and an empty table gives no rows. ``batch_bytes`` is
    what each core brings to a batch of the family; results do not depend on it.
    """
    if not (0 < block <= length // 2 and 0 < prefix < length and 0 < chunk <= CHUNK):
        raise ValueError(f"a prefix is shorter than the length, a block at most half of it, a chunk at most {CHUNK}")
    spark = docs.sparkSession
    work = Workspace(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Rows are named by what they hold, so every pass over the texts names them alike.
    named = named.withColumns({"r1": F.xxhash64("doc_id", "text"), "r2": F.xxhash64(F.lit(7), "text", "doc_id")})
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-total // (batch_bytes * spark.sparkContext.defaultParallelism)))
    spans = repeated_spans(named.select("r1", "r2", "text"), work, Shape(length, prefix, block, chunk), batches)
    found = work.keep(spans.groupBy("r1", "r2").agg(F.collect_list(F.struct("at", "n")).alias("found")), "spans")
    work.drop("regions", "screened", "blocks", "windows", "kinds")
    out = named.join(found.hint("merge"), ["r1", "r2"], "left").select("doc_id", "text", "found")
    return out.mapInArrow(_cut(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>, kept binary")
