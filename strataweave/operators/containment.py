"""Which of many names a text contains, by window hashes against bitmaps and an equality join.

A name of length L has a level k with 2**k <= L < 2**(k+1). The hashes of its first and of its last
2**k code points cover it, so a bitmap of (first hash), one of (first, last, length) and the set of
lengths in use tell from a text's own windows which of its substrings may be names. What passes
is joined with the names by equality: bitmaps decide how much is joined, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

#: Names of one pass over the texts; more of them take further passes, each with bitmaps of its own.
SHARD_NAMES = 1 << 22
#: Bits of a bitmap for one name, rounded up to a power of two: at SHARD_NAMES a bitmap has 32 MB.
BITS_A_NAME, LEAST_BITS = 64, 16
#: Code points that are hashed at once; a longer text is cut into slices that overlap by the longest name.
SLICE = 1 << 19
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _A
    return h ^ (h >> np.uint64(29))


def _levels(codes: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, hashes of all windows of 2**k code points) up to ``top``, each level from the one below."""
    h = _mixed(codes.astype(np.uint64) + _B)
    for k in range(top + 1):
        if k:
            w = 1 << (k - 1)
            if len(h) <= w:
                return
            h = _mixed(h[:-w] * _B + h[w:] + np.uint64(k))
        yield k, h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pair(first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    return _mixed(first * _C + last + np.uint64(length))


def _places(pair: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return pair >> np.uint64(64 - bits), (pair * _B) >> np.uint64(64 - bits)


def _marks(bits: int) -> Callable[[Column], Column]:
    """Of each name its places in the three bitmaps: first hash, pair (from 2**bits), length (from 2**(bits+1))."""

    @F.pandas_udf(ArrayType(LongType()))
    def marks(names: pd.Series) -> pd.Series:
        def one(name: str) -> list[int]:
            n = len(name)
            k = n.bit_length() - 1
            *_, (_, h) = _levels(_codes(name), k)
            pair = _pair(h[:1], h[-1:], n)
            return [int(h[0] >> np.uint64(64 - bits)), *(int(p[0]) + (1 << bits) for p in _places(pair, bits)), n + (2 << bits)]

        return names.map(one)

    return marks


def _tested(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _scan(codes: np.ndarray, ends: np.ndarray, first: np.ndarray, pairs: np.ndarray, lengths: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """(starts, length) of substrings that may be names, equal ones once for each text; ``ends`` are the texts' borders."""
    top = int(lengths[-1]).bit_length() - 1
    for k, h in _levels(codes, top):
        own = lengths[(lengths >> k) == 1]
        if not len(own):
            continue
        at = np.flatnonzero(_tested(first, h >> np.uint64(64 - bits)))
        text = np.searchsorted(ends, at, side="right")
        room = ends[text] - at
        for n in own.tolist():
            fits = room >= n
            p = at[fits]
            if not len(p):
                continue
            pair = _pair(h[p], h[p + (n - (1 << k))], n)
            one, two = _places(pair, bits)
            ok = _tested(pairs, one) & _tested(pairs, two)
            if ok.any():
                _, once = np.unique(_mixed(pair[ok] + text[fits][ok].astype(np.uint64) * _C), return_index=True)
                yield p[ok][once], n


def _slices(texts: list[str | None], longest: int, most: int) -> Iterator[list[tuple[int, str]]]:
    """(text number, part) lists of about ``most`` code points; parts of one text overlap by ``longest`` - 1."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for a in range(0, len(text or ""), most):
            part = text[a : a + most + longest - 1]
            if size and size + len(part) > most:
                yield held
                held, size = [], 0
            held.append((i, part))
            size += len(part)
            if a + len(part) == len(text):
                break
    if held:
        yield held


def _finder(bitmap, bits: int, lengths: np.ndarray) -> Callable[[Column], Column]:
    """Substrings of a text that may be names, each once; all that are names are among them."""
    longest, most = int(lengths[-1]), SLICE

    @F.pandas_udf(ArrayType(StringType()))
    def find(text: pd.Series) -> pd.Series:
        words = 1 << (bits - 6)
        first, pairs = bitmap.value[:words], bitmap.value[words : 2 * words]
        found: list[set[str]] = [set() for _ in range(len(text))]
        for held in _slices(text.tolist(), longest, most):
            joined = "".join(part for _, part in held)
            ends = np.cumsum([len(part) for _, part in held])
            owner = [i for i, _ in held]
            for starts, n in _scan(_codes(joined), ends, first, pairs, lengths, bits):
                for p, t in zip(starts.tolist(), np.searchsorted(ends, starts, side="right").tolist(), strict=True):
                    found[owner[t]].add(joined[p : p + n])
        return pd.Series([sorted(x) for x in found])

    return find


def _bitmaps(names: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(both bitmaps, sorted lengths in use): 2**(bits+1) bits and as many lengths as the longest name has at most."""
    at = F.col("_at")
    words = names.select(F.explode(_marks(bits)("_low")).alias("_at")).groupBy(F.shiftright(at, 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, int(_at & 63))")).alias("_b")).toPandas()
    place, value = words["_w"].to_numpy(np.int64), words["_b"].to_numpy(np.int64).view(np.uint64)
    out = np.zeros(2 << (bits - 6), np.uint64)
    inner = place < len(out)
    out[place[inner]] = value[inner]
    lengths = [((int(w) - len(out)) << 6) + b for w, v in zip(place[~inner], value[~inner], strict=True) for b in range(64) if int(v) >> b & 1]
    return out, np.array(sorted(lengths), np.int64)


def contains_join(texts: DataFrame, names: DataFrame, *, text: str, name: str) -> DataFrame:
    """Pairs where the lower-cased text contains the lower-cased name; null and empty names match nothing.

    The rows are the texts' columns and the names'. One plan at every size: a pass
    over each text for every ``SHARD_NAMES`` names finds its substrings that may be
    names, by bitmaps of a bit count that the names set, 32 MB each at most; the
    substrings then meet the names by equality. Memory of a task is bounded by an
    Arrow batch of texts, a slice and the longest name. A text is not shuffled
    unless the caller selects it; a name that all texts contain, or one that is
    repeated, makes as many rows as there are pairs. Names that differ in case
    only are different names.
    """
    keyed = names.where(F.col(name).isNotNull() & (F.col(name) != "")).withColumn("_low", F.lower(name))
    spark = texts.sparkSession
    n = keyed.count()
    shards = max(1, -(-n // SHARD_NAMES))
    bits = max(LEAST_BITS, (BITS_A_NAME * -(-n // shards) - 1).bit_length())
    out = None
    for shard in range(shards):
        own = keyed if shards == 1 else keyed.where(F.pmod(F.xxhash64("_low"), F.lit(shards)) == shard)
        held, lengths = _bitmaps(own, bits)
        if not len(lengths):
            continue
        found = texts.withColumn("_low", F.explode(_finder(spark.sparkContext.broadcast(held), bits, lengths)(F.lower(text))))
        hits = found.join(own, "_low").drop("_low")
        out = hits if out is None else out.unionByName(hits)
    return texts.join(names, F.lit(False)) if out is None else out
