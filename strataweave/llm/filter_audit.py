"""Filter interaction audit: what each order of filters removes, by adjacent transpositions.

1. One pass over the texts gives each document a bit mask of the filters it fails,
   and a digest of its text. Copies are found by the least identifier of a digest;
   rows are summed before they are shuffled, so a large group of copies is a few rows.
2. Documents fall together into cells (part, mask) with counts; a part has at most
   two to the number of filters of them, however many documents there are.
3. The orders of the filters are visited by single swaps of neighbours
   (``transpositions``). A swap of positions i and i + 1 changes what is removed at
   these two steps only, so just these two are summed anew from the cells; a
   filter's Shapley sum grows by its removals times the orders they lasted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Filters of ``text_masks`` in the order of their bits; the last one needs the whole table.
LETTERS = "ABCDE"
#: Bytes beyond which a text's words are met one by one, so that memory holds its distinct words only.
BLOCK = 1 << 22
SALTS = 4096
#: Filters whose orders one group walks: 8 have 40,320.
MOST_FILTERS = 8
_UPPER = bytes(range(65, 91))
_ODD = b"#$%&*|"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def text_mask(text: str | None) -> tuple[int, bytes]:
    """Bits of the filters A to D that a text fails, and its SHA-256. Null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= BLOCK:
        words = raw.split()  # bytes split at [\x20\x09-\x0D] only
        n, different = len(words), len(set(words))
    else:
        n, seen = 0, set()
        for m in _WORD.finditer(raw):
            n += 1
            seen.add(m[0])
        different = len(seen)
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    odd = len(raw) - len(raw.translate(None, _ODD))
    failed = (n < 200, 100 * different < 50 * n, 100 * capitals > 3 * len(text), odd > 0)
    return sum(f << k for k, f in enumerate(failed)), hashlib.sha256(raw).digest()


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, digests = [], []
        for text in batch.column("text"):
            mask, digest = text_mask(text.as_py())
            masks.append(mask)
            digests.append(digest)
        rest = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=[*rest.schema.names, "mask", "digest"])


def cells(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters they fail, and those labelled good or toxic.

    A null part is the empty string. A document has a label if any row of ``labels``
    (doc_id, quality, toxic) with its id does; rows with a null id have none, are
    nobody's copies and come after all others. Rows that repeat an id count each and
    are no copies of each other. An empty table has no cells.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    rows = base.mapInArrow(_masks, f"id {kind}, part string, mask int, digest binary")
    # Rows without an id would meet in one task: their salt deals them out, and no label has it.
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS)) + 1).otherwise(0))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast(kind).alias("id"), F.lit(0).cast("long").alias("salt"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = rows.join(known, ["id", "salt"], "left").na.fill(0, ["good", "toxic"])
    # Rows of one id first, so that the rows at a group's least id are counted; then groups of one text.
    keys = ["digest", "part", "mask", "good", "toxic"]
    same = joined.groupBy("id", "salt", *keys).agg(F.count("*").alias("n"))
    own = same.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", F.col("id")).alias("at_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("loose"))
    # A text has few groups, one for each part and label, so this window never holds many rows of a digest.
    first = F.min("least").over(Window.partitionBy("digest"))
    stays = F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(F.lit(0)) + F.col("loose")
    spread = own.withColumn("first", first).withColumn("stays", stays)
    bit = 1 << LETTERS.index("E")
    two = F.array(F.struct(F.col("mask").alias("mask"), F.col("stays").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("stays")).alias("n")))
    cell = spread.select("part", "good", "toxic", F.explode(two).alias("c")).where("c.n > 0")
    count = lambda flag: F.sum(F.col("c.n") * F.col(flag))
    return cell.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def transpositions(n: int) -> Iterator[int]:
    """Positions i whose swap with i + 1 leads from the identity through all other orders of n items, each once."""
    place, toward = list(range(n)), [-1] * n  # of each item
    order = list(range(n))
    while True:
        for item in range(n - 1, -1, -1):
            at = place[item] + toward[item]
            if 0 <= at < n and order[at] < item:
                break
        else:
            return
        other, i = order[at], min(at, place[item])
        order[place[item]], order[at] = other, item
        place[item], place[other] = at, place[item]
        for larger in range(item + 1, n):
            toward[larger] = -toward[larger]
        yield i


class Walk:
    """The steps of one order of filters, kept true over single swaps."""

    def __init__(self, found: list[tuple[int, int, int, int]], letters: str):
        self.cells, self.letters, self.order = found, letters, list(range(len(letters)))
        self.total = sum(c[1] for c in found)
        self.fails = [sum(c[1] for c in found if c[0] >> f & 1) for f in self.order]
        self.alone = [sum(c[1] for c in found if c[0] == 1 << f) for f in self.order]
        self.steps: list[tuple[int, int, int]] = [(0, 0, 0)] * len(letters)
        self.since, self.shapley, self.visited = [0] * len(letters), [0] * len(letters), 0
        for i in self.order:
            self._sum(i)

    def _sum(self, i: int) -> None:
        """Removed, good and toxic at step i, from the cells that pass all filters before it."""
        before, bit = sum(1 << f for f in self.order[:i]), 1 << self.order[i]
        hit = [c for c in self.cells if c[0] & bit and not c[0] & before]
        self.steps[i] = (sum(c[1] for c in hit), sum(c[2] for c in hit), sum(c[3] for c in hit))

    def _settle(self, i: int) -> None:
        """Add what step i's filter removed in the orders since it last changed."""
        f = self.order[i]
        self.shapley[f] += self.steps[i][0] * (self.visited - self.since[f])
        self.since[f] = self.visited

    def visit(self) -> list[tuple]:
        """(filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) of this order."""
        self.visited += 1
        kept, rows, name = self.total, [], "".join(self.letters[f] for f in self.order)
        for i, f in enumerate(self.order):
            removed, good, toxic = self.steps[i]
            kept -= removed
            rows.append((name, i + 1, f, kept, removed, self.fails[f] - removed, self.alone[f], good, toxic))
        return rows

    def swap(self, i: int) -> None:
        for k in (i, i + 1):
            self._settle(k)
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]
        for k in (i, i + 1):
            self._sum(k)

    def all(self) -> list[tuple]:
        """The rows of all orders, each with its filter's Shapley sum."""
        rows = self.visit()
        for i in transpositions(len(self.letters)):
            self.swap(i)
            rows += self.visit()
        for i in range(len(self.letters)):
            self._settle(i)
        return [(*r[:2], *r[3:], self.shapley[r[2]]) for r in rows]


_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _walked(letters: str):
    def run(table: pa.Table) -> pa.Table:
        cells_ = list(zip(*(table.column(c).to_pylist() for c in ("mask", "n", "good", "toxic")), strict=True))
        columns = list(zip(*Walk(cells_, letters).all(), strict=True))
        part = pa.array([table.column("part")[0].as_py()] * len(columns[0]), pa.string())
        return pa.Table.from_arrays([part, pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["part", "filter_order", "step", *_COUNTS])

    return run


def audit(found: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: all orders of each part.

    ``found`` has cells (part, mask, n, good, toxic), one row a part and mask at most;
    bit k of a mask stands for filter ``letters[k]``. A step's filter is the letter of
    ``filter_order`` at it. All counts are of documents, zeros included; ``shapley`` is
    the filter's ``removed`` summed over all orders. One part is walked in one task,
    which reads at most two to the number of filters rows.
    """
    if not 0 < len(letters) <= MOST_FILTERS or len(set(letters)) != len(letters):
        raise ValueError(f"one to {MOST_FILTERS} different letters, not {letters!r}")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)
    return found.groupBy("part").applyInArrow(_walked(letters), schema)


def audit_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``audit`` of the five filters of ``LETTERS`` over whole documents; see ``cells`` for nulls, repeats and empty tables.

    A: under 200 words; B: under half of the words distinct; C: over 3% capitals
    ``[A-Z]``; D: any of ``#$%&*|``; E: the text of a smaller identifier. Words are
    maximal ``[^\\x20\\x09-\\x0D]+``. Other columns are ignored.
    """
    return audit(cells(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col))
