"""Line dedup: explode keyed lines, count documents per key, drop, reassemble by position."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import arrowtext as at
from .workspace import Workspace

OUTPUTS = ["n_lines", "n_dropped", "kept_sha256", "kept_text"]
#: Rows that are rebuilt at once.
ROWS = 256
_U = np.uint64
_A = (at.constants(41, 256) | _U(1))[at._LOWER]
_B = (at.constants(42, 256) | _U(1))[at._LOWER]


def _keyed(raw: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of every line: text, place in the text, 128-bit key, and whether its key is long enough."""
    n = len(offsets) - 1
    cut = np.flatnonzero(raw == 10)
    text = np.concatenate([np.arange(n), np.searchsorted(offsets, cut, side="right") - 1])
    start = np.concatenate([offsets[:-1], cut + 1])
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    end[-1:] = offsets[-1]
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    end[last] = offsets[text[last] + 1]
    place = np.arange(len(text)) - np.searchsorted(text, text)
    # Strip: first and last byte of the line that is not white space.
    solid = np.flatnonzero(~at._SPACE[raw])
    if len(solid):
        lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, end)
        some = hi > lo
        first = np.where(some, solid[np.minimum(lo, len(solid) - 1)], start)
        stop = np.where(some, solid[np.maximum(hi - 1, 0)] + 1, first)
    else:
        first, stop = start, start
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    long_enough = heads[stop] - heads[first] >= least
    first, stop = first[long_enough], stop[long_enough]
    return text[long_enough], place[long_enough], at.run_hashes(raw, first, stop, _A), at.run_hashes(raw, first, stop, _B)


def _keys(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = at.utf8(batch.column("text"))
            ids = batch.column("doc_id")
            for a, b in at.slices(off):
                text, place, k1, k2 = _keyed(raw[off[a] : off[b]], off[a : b + 1] - off[a], least)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(text + a)), pa.array(place.astype(np.int32)), pa.array(at.signed(k1)), pa.array(at.signed(k2))], names=["doc_id", "place", "k1", "k2"])

    return run


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        # Python texts exist for a slice of rows at a time.
        for batch in (whole.slice(a, ROWS) for a in range(0, whole.num_rows, ROWS)):
            lines, dropped, digest, kept = [], [], [], []
            for text, drop in zip(batch.column("text"), batch.column("places"), strict=True):
                text = text.as_py() or ""
                gone = set(drop.as_py() or ())
                parts = text.split("\n")
                body = "\n".join([x for i, x in enumerate(parts) if i not in gone]) if gone else text
                lines.append(len(parts))
                dropped.append(len(gone))
                digest.append(hashlib.sha256(body.encode()).hexdigest())
                kept.append(body)
            rest = batch.drop_columns(["text", "places"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=[*rest.schema.names, *OUTPUTS])


def dedup_lines(docs: DataFrame, *, threshold: int = 3, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The input's columns without the text, plus n_lines, n_dropped, kept_sha256, kept_text.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased,
    compared by 128-bit hash. Keys of ``least_chars`` code points or more that
    ``threshold`` or more documents hold lose all their lines except in the
    greatest id that holds them. Null or empty text is one empty line. Rows that
    repeat an id count as one document and share their dropped positions; rows
    with a null id lose nothing and are not counted. Ids may be of any type that
    orders. Very long texts are read whole; an empty table gives no rows. Input
    columns with the names of outputs are replaced; with ``carry`` a column
    ``input`` holds them all as a struct instead, whatever their names.
    """
    work = Workspace(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    keys = work.keep(light.mapInArrow(_keys(least_chars), f"doc_id {kind}, place int, k1 long, k2 long"), "keys")
    lines = keys.count()
    once = keys.select("k1", "k2", "doc_id").distinct()
    common = work.keep(once.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= threshold).select("k1", "k2", "keeper"), "common", rows=lines)
    # Both right sides grow with the corpus, so they are merged and never broadcast.
    gone = keys.join(common.hint("merge"), ["k1", "k2"]).where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    gone = work.keep(gone, "gone", rows=lines)
    rest = [c for c in docs.columns if c != text_col]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("input"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = base.join(gone.hint("merge"), "doc_id", "left").select("input", "text", "places")
    counts = [StructField(c, LongType() if c.startswith("n_") else StringType()) for c in OUTPUTS]
    out = marked.mapInArrow(_rebuild, StructType([base.schema["input"], *counts]))
    return out if carry else out.select(*[F.col("input").getField(c).alias(c) for c in rest if c not in OUTPUTS], *OUTPUTS)
