"""Phrase collocations by hashed candidate counting (PCY, DHP) with Apriori pruning.

Pass k reads the texts once. It counts phrases of k words exactly, if both their
parts of k - 1 words are frequent and their bucket is, and hashes the phrases of
k + 1 words that may still be frequent into 2**``BITS`` buckets. Between passes the
bucket counts of all tasks are added, block by block, and leave one bit a bucket;
the frequent phrases themselves leave a second bitmap. Both have a fixed size, so
they are broadcast whatever the corpus. A set bit admits, it never counts: what
passes is counted exactly by its words, so larger corpora only prune less.

Counters never hold more than ``HELD`` entries a task; a bucket's share of one task
is cut at the least frequency, which no decision can see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrowtext as at
from .workspace import Workspace

#: Buckets and bits of a bitmap: 2**26 bits are 8 MB.
BITS = 26
_BLOCK = 16
#: Counted phrases and bucket numbers that a task holds before it sends them on.
HELD = 1 << 19
BUCKETED = 1 << 20
#: Parts of a language that are ranked on their own before their best rows meet.
RANK_PARTS = 64
_U = np.uint64
_STEP = at.constants(51, 64) | _U(1)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _SEPARATOR.copy()
_GAP[[0x20, 0x09]] = True
_PASS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("block", pa.int32()), ("packed", pa.binary())])
_PASS_SQL = "lang string, phrase string, n long, block int, packed binary"


class Words:
    """The words of a byte range: where they stand, their hashes by language, and which stand in one piece."""

    def __init__(self, raw: np.ndarray, edges: np.ndarray, lang_hash: np.ndarray, first_text: int):
        """``edges``: where texts begin inside ``raw``, the first of which is number ``first_text``."""
        solid = ~_GAP[raw]
        before = np.zeros(len(raw), bool)
        before[1:] = solid[:-1]
        inside = edges[(edges > 0) & (edges < len(raw))]
        before[inside] = False
        after = np.zeros(len(raw), bool)
        after[:-1] = solid[1:]
        after[inside - 1] = False
        self.raw = np.append(at._LOWER[raw], np.uint8(32))
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.text = np.searchsorted(inside, self.starts, side="right") + first_text
        # Both terms never fall, so equal sums mean equal terms.
        self.piece = np.cumsum(_SEPARATOR[raw])[self.starts] + self.text if len(raw) else self.text
        self.hashes = at.mix64(at.run_hashes(raw, self.starts, self.ends, at._BYTE) ^ lang_hash[self.text])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: the hash of the k words from it on, and whether they are k words of one piece."""
        n = len(self.hashes)
        if k == 1:
            return self.hashes, np.ones(n, bool)
        out, whole = np.zeros(n, np.uint64), np.zeros(n, bool)
        if n >= k:
            total = self.hashes[: n - k + 1] * _STEP[0]
            for j in range(1, k):
                total = total + self.hashes[j : n - k + 1 + j] * _STEP[j]
            out[: n - k + 1] = at.mix64(total + _U(k))
            whole[: n - k + 1] = self.piece[: n - k + 1] == self.piece[k - 1 :]
        return out, whole

    def phrases(self, at_word: np.ndarray, k: int) -> pa.Array:
        """The k words from each given word on, joined by single spaces."""
        blank = len(self.raw) - 1
        runs_a, runs_b = np.full((len(at_word), 2 * k - 1), blank), np.full((len(at_word), 2 * k - 1), blank + 1)
        for j in range(k):
            runs_a[:, 2 * j], runs_b[:, 2 * j] = self.starts[at_word + j], self.ends[at_word + j]
        size = (runs_b - runs_a).ravel()
        first = np.cumsum(size) - size
        data = self.raw[np.arange(int(size.sum())) + np.repeat(runs_a.ravel() - first, size)]
        offsets = np.zeros(len(at_word) + 1, np.int32)
        np.cumsum(size.reshape(-1, 2 * k - 1).sum(1), out=offsets[1:])
        return pa.StringArray.from_buffers(len(at_word), pa.py_buffer(offsets), pa.py_buffer(data))


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[Words, pa.Array]]:
    """Words of about ``SLICE_BYTES`` of text at a time, cut at pieces' ends; with the batch's languages."""
    raw, off = at.utf8(batch.column("text"))
    langs = batch.column("lang")
    tags, tag_off = at.utf8(langs)
    lang_hash = at.mix64(at.run_hashes(tags, tag_off[:-1], tag_off[1:], at.constants(52, 256) | _U(1)) + _U(1)) if len(tags) else np.zeros(batch.num_rows, np.uint64)
    cuts = np.union1d(np.flatnonzero(_SEPARATOR[raw]) + 1, off)
    a = 0
    while a < len(raw):
        k = int(np.searchsorted(cuts, a + at.SLICE_BYTES, side="right")) - 1
        b = int(cuts[k]) if cuts[k] > a else int(cuts[min(k + 1, len(cuts) - 1)])
        first = int(np.searchsorted(off, a, side="right")) - 1
        last = int(np.searchsorted(off, b, side="left"))
        # Empty texts repeat an offset and hold no word, so edges that repeat still number the texts.
        yield Words(raw[a:b], off[first + 1 : last] - a, lang_hash, first), langs
        a = b


def _held(bits: np.ndarray, hashes: np.ndarray, *, high: bool) -> np.ndarray:
    """Whether each hash's bit is set."""
    place = _place(hashes, high=high)
    return (bits[place >> _U(3)] >> (place & _U(7)).astype(np.uint8) & 1).astype(bool)


def _place(hashes: np.ndarray, *, high: bool) -> np.ndarray:
    """Bucket numbers; frequent phrases use other bits of a hash than buckets do."""
    return hashes >> _U(64 - BITS) if high else hashes & _U((1 << BITS) - 1)


def _packed(places: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Counts of bucket numbers, cut at ``most``: one row for each block of 2**16 buckets, (offset, count) in three bytes."""
    if not len(places):
        return
    place, count = np.unique(places, return_counts=True)
    cells = np.empty(len(place), dtype=[("at", "<u2"), ("n", "u1")])
    cells["at"], cells["n"] = place & place.dtype.type((1 << _BLOCK) - 1), np.minimum(count, most)
    block = (place >> place.dtype.type(_BLOCK)).astype(np.int32)
    cut = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
    packed = [cells[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
    n = len(packed)
    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(block[cut[:-1]]), pa.array(packed, pa.binary())], schema=_PASS)


class _Counts:
    """Phrases counted in this task so far; equal ones fall together before any leaves."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray, langs: pa.Array, phrases: pa.Array) -> Iterator[pa.RecordBatch]:
        self.parts.append((hashes, counts, langs, phrases))
        self.rows += len(hashes)
        if self.rows > 2 * HELD:
            self._merge()
            if self.rows > HELD:
                yield from self.leave()

    def _merge(self) -> None:
        hashes, counts = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, group, counts)
        langs, phrases = (pa.concat_arrays([p[i] for p in self.parts]).take(pa.array(first)) for i in (2, 3))
        self.parts, self.rows = [(hashes[first], total, langs, phrases)], len(first)

    def leave(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            self._merge()
            _, counts, langs, phrases = self.parts[0]
            n = len(counts)
            yield pa.RecordBatch.from_arrays([langs, phrases, pa.array(counts), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_PASS)
        self.parts, self.rows = [], 0


def _pass(k: int, last: bool, least: int, parts, buckets):
    """Pass k: exact counts of admitted phrases of k words, and bucket counts of the next length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, places, waiting = _Counts(), [], 0
        for batch in batches:
            for words, langs in _ranges(batch):
                own, good = words.grams(k)
                if k > 1:
                    part = _held(parts.value, words.grams(k - 1)[0], high=True)
                    good[:-1] &= part[:-1] & part[1:]
                    good &= _held(buckets.value, own, high=False)
                some = np.flatnonzero(good)
                hashes, first, count = np.unique(own[some], return_index=True, return_counts=True)
                if len(hashes):
                    at_word = some[first]
                    yield from counts.add(hashes, count, langs.take(pa.array(words.text[at_word])), words.phrases(at_word, k))
                if not last:
                    longer, whole = words.grams(k + 1)
                    whole[:-1] &= good[:-1] & good[1:]
                    places.append(_place(longer[whole], high=False).astype(np.uint32))
                    waiting += len(places[-1])
                    if waiting > BUCKETED:
                        yield from _packed(np.concatenate(places), least)
                        places, waiting = [], 0
        yield from counts.leave()
        if places:
            yield from _packed(np.concatenate(places), least)

    return run


def _hashed(k: int):
    """The bits of given phrases of k words, as packed counts of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, _ in _ranges(batch):
                own, whole = words.grams(k)
                yield from _packed(_place(own[whole], high=True), 1)

    return run


def _bits(least: int):
    """Packed counts, sorted by block: which buckets reach ``least``, as one row of bits a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(1 << _BLOCK, np.int64)

        def done() -> pa.RecordBatch:
            bits = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for b, packed in zip(batch.column("block").to_pylist(), batch.column("packed"), strict=True):
                if b != block:
                    if block is not None:
                        yield done()
                    block = b
                    total[:] = 0
                cells = np.frombuffer(packed.as_py(), dtype=[("at", "<u2"), ("n", "u1")])
                total[cells["at"]] += cells["n"]
        if block is not None:
            yield done()

    return run


def _broadcast_bits(packed: DataFrame, least: int):
    """The bitmap of all tasks' packed counts, 2**BITS bits whatever they hold, as a broadcast."""
    spark = packed.sparkSession
    dealt = packed.select("block", "packed").repartition("block").sortWithinPartitions("block")
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for row in dealt.mapInArrow(_bits(least), "block int, bits binary").collect():
        size = 1 << (_BLOCK - 3)
        bits[row.block * size : (row.block + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(bits)


def phrase_counts(docs: DataFrame, work: Workspace, *, longest: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, length, f) of all phrases of up to ``longest`` words found ``least`` times, (lang, n) of all words)."""
    base = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    found, parts, buckets, sizes = None, None, None, None
    for k in range(1, longest + 1):
        out = work.keep(base.mapInArrow(_pass(k, k == longest, min(least, 255), parts, buckets), _PASS_SQL), f"pass-{k}")
        counted = out.where("block is null")
        if k == 1:
            sizes = work.keep(counted.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
        frequent = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        frequent = work.keep(frequent.select("lang", "phrase", F.lit(k).alias("length"), "f"), f"frequent-{k}")
        found = frequent if found is None else found.unionByName(frequent)
        if k < longest:
            buckets = _broadcast_bits(out.where("block is not null"), min(least, 255))
            parts = _broadcast_bits(frequent.select("lang", F.col("phrase").alias("text")).mapInArrow(_hashed(k), _PASS_SQL), 1)
        work.drop(f"pass-{k}")
    return found, sizes


def _span(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, *, longest: int = 3, least: int = 10, top: int = 2000, cover: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of two to ``longest`` words of each language.

    Texts have A-Z lower-cased (null: empty), end pieces at ``[.,;:!?\\x0A-\\x0D]`` and
    words at spaces and tabs; everything is counted per language (null: ``und``).
    ``a`` counts a phrase inside pieces, overlaps included, ``n`` all words; phrases
    with ``a`` of ``least`` or more are candidates. A cut after k words gives the
    parts' counts ``l`` and ``r`` and floor(1000000 * a * a / (l * r)); the least
    score counts, of equal ones that of the smallest k. A candidate leaves if a longer
    one that holds it reaches ``cover`` hundredths of its count. Rank is by score and
    ``a`` descending, then by the phrase's bytes, so ties have one order. Repeated
    rows count each; texts of any length are read in ranges; other columns are
    ignored; an empty table gives no rows.
    """
    if not (2 <= longest <= 8 and least >= 1):
        raise ValueError("phrases have two to eight words and are found at least once")
    work = Workspace(docs.sparkSession)
    counts, sizes = phrase_counts(docs, work, longest=longest, least=least, lang_col=lang_col, text_col=text_col)
    words = F.split("phrase", " ", -1)
    candidates = counts.where("length >= 2").select("lang", "phrase", "length", F.col("f").alias("a"))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cut = cut.withColumns({"left": _span(words, F.lit(1), F.col("k")), "right": _span(words, F.col("k") + 1, F.col("length") - F.col("k"))})
    # Both sides grow with the corpus: they are merged, and a word with a large share of all phrases is split by the adaptive join.
    for side, name in (("left", "l"), ("right", "r")):
        part = counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cut = cut.join(part.hint("merge"), ["lang", side])
    # 15 digits for each count keep 1,000,000 * a * a and l * r within the 38 digits of a decimal.
    cut = cut.withColumn("score", F.expr("(CAST(1000000 AS DECIMAL(7,0)) * CAST(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) AS DECIMAL(30,0))) DIV (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))"))
    best = cut.groupBy("lang", "phrase", "length", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = candidates.where("length > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("length") - 1)))
    longer = longer.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("m") + 1)))
    held = longer.groupBy("lang", _span(words, F.col("i"), F.col("m")).alias("phrase")).agg(F.max("a").alias("most"))
    left = best.join(held.hint("merge"), ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("a")))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
