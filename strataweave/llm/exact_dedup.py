"""Exact dedup by a log-structured merge index of text digests; native DataFrame operations only.

A run is a bucketed Parquet table of (digest, least id, rows), sorted by digest
inside each bucket, with a bit filter of its digests beside it. ``flush`` turns a
memtable into a run of level 0; ``FAN`` runs of a level merge into one of the next
level by a join of equal buckets, which needs no shuffle and keeps the least
identifier. ``screen`` drops rows whose digest a run cannot hold, by its filter.
Hits, the digests that stand for several rows, form a run of their own; only rows
that pass its filter bring their bytes, which are compared before anything is dropped.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Memtables that one call deals its rows into, and runs of a level that merge into one of the next.
MEMTABLES = 4
FAN = 4
#: Rows of a run that one bucket holds on average.
BUCKET_ROWS = 131_072
#: Bits of a filter for each digest, and the most that a filter takes: 2**26 bits are 8 MB, whatever the run's size.
FILTER_BITS = 16
FILTER_CAP = 1 << 26
#: Bits of one row of a filter: what ``bitmap_construct_agg`` holds.
_PAGE = 1 << 15
#: A digest with more than a thousandth of all rows is joined by broadcast; there are under a thousand of them.
HOT_SHARE = 1000
WHITE = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


@dataclass
class Run:
    """A sorted run of one level: its table's name, its rows, its digests' filter and the filter's bits."""

    table: str
    rows: DataFrame
    level: int
    filter: DataFrame
    bits: int


class DigestIndex:
    """Levels of sorted runs of (digest, id, n) in the shared folder.

    ``buckets`` is the number of buckets of every run; runs of one index must agree on it to merge.
    """

    def __init__(self, work: Workspace, *, buckets: int, fan: int = FAN, name: str = "lsm"):
        self.work, self.buckets, self.fan, self.name = work, buckets, fan, name
        self.levels: list[list[Run]] = []
        self.written = 0

    def _place(self, digest: Column, bits: int) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(bits))

    def write(self, rows: DataFrame, level: int, *, bucketed: bool = True) -> Run:
        """Rows (digest, id, n) as a sorted, bucketed run with its filter; they are unique by digest."""
        spark, path = self.work.spark, f"{self.work.base}/{self.name}-level{level}-run{self.written}"
        self.written += 1
        named = f"lsm_{uuid.uuid4().hex}"
        placed = rows if bucketed else rows.repartition(self.buckets, "digest")
        placed.write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", path).format("parquet").saveAsTable(named)
        table = spark.table(named)
        bits = _PAGE
        wanted = FILTER_BITS * table.count()
        while bits < min(wanted, FILTER_CAP):
            bits *= 2
        bit = self._place(F.col("digest"), bits)
        pages = table.select(F.floor(bit / _PAGE).cast("int").alias("page"), (bit % _PAGE).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("held"))
        return Run(named, table, level, self.work.keep(pages.coalesce(1), f"{self.name}-filter{self.written}"), bits)

    def _retire(self, run: Run) -> None:
        self.work.spark.sql(f"DROP TABLE IF EXISTS {run.table}")

    def flush(self, entries: DataFrame) -> None:
        """A memtable of (digest, id): it leaves as one sorted run; full levels merge upwards."""
        memtable = entries.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"))
        self._add(self.write(memtable, 0, bucketed=False))

    def _add(self, run: Run) -> None:
        while len(self.levels) <= run.level:
            self.levels.append([])
        self.levels[run.level].append(run)
        if len(self.levels[run.level]) >= self.fan:
            merged = self._merge(self.levels[run.level], run.level + 1)
            self.levels[run.level] = []
            self._add(merged)

    def _merge(self, runs: list[Run], level: int) -> Run:
        """Sorted runs into one: equal digests keep their least id and the sum of rows. Equal buckets meet, so nothing is shuffled."""
        out = runs[0].rows
        for k, run in enumerate(runs[1:]):
            other = run.rows.select(F.col("digest").alias(f"_d{k}"), F.col("id").alias(f"_i{k}"), F.col("n").alias(f"_n{k}"))
            joined = out.join(other.hint("merge"), F.col("digest") == F.col(f"_d{k}"), "full_outer")
            # least skips nulls, so an id wins over none.
            out = joined.select(F.coalesce("digest", f"_d{k}").alias("digest"), F.least("id", f"_i{k}").alias("id"), (F.coalesce("n", F.lit(0)) + F.coalesce(f"_n{k}", F.lit(0))).alias("n"))
        merged = self.write(out, level)
        for run in runs:
            self._retire(run)
        return merged

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def compact(self) -> Run:
        """All runs as one."""
        runs = self.runs()
        if len(runs) > 1:
            merged = self._merge(runs, max(r.level for r in runs) + 1)
            self.levels = [[] for _ in range(merged.level)] + [[merged]]
        return self.runs()[0]

    def screen(self, rows: DataFrame, run: Run) -> DataFrame:
        """Rows whose digest the run may hold; those it holds all stay. The filter is broadcast: its size has a fixed bound."""
        pages = run.filter.select(F.col("page").alias("_page"), F.col("held").alias("_held"))
        placed = rows.withColumn("_bit", self._place(F.col("digest"), run.bits))
        near = placed.join(F.broadcast(pages), F.floor(F.col("_bit") / _PAGE).cast("int") == F.col("_page")).withColumn("_bit", (F.col("_bit") % _PAGE).cast("int"))
        byte = "CAST(conv(hex(substring(_held, _bit div 8 + 1, 1)), 16, 10) AS INT)"
        return near.where(F.expr(f"shiftright({byte}, _bit % 8) & 1 = 1")).drop("_bit", "_page", "_held")

    def probe(self, digests: DataFrame) -> DataFrame:
        """(digest, id, n) of what any run holds for a table of digests; each run is screened by its filter before it is joined."""
        found = None
        for run in self.runs():
            hit = self.screen(digests.select("digest").distinct(), run).join(run.rows, "digest").select("digest", "id", "n")
            found = hit if found is None else found.unionByName(hit)
        return found.groupBy("digest").agg(F.min("id").alias("id"), F.sum("n").alias("n"))

    def drop(self) -> None:
        """Forget the runs' names; their files stay with the workspace."""
        for run in self.runs():
            self._retire(run)


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_hex: int = 64, memtables: int = MEMTABLES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Texts are equal when identical after every run of white space became one
    space (null: empty text). ``keep_id`` is the least id of equal texts, as the
    compacted index holds it. Rows that repeat an id count each; all rows with the
    kept id are kept. A null id is greater than any other; a group with null ids
    only keeps them under a null ``keep_id``. ``digest_hex`` shortens the digest of
    the index (tests use that to force collisions); results do not depend on it.
    Empty and very long texts are texts like others, other columns are ignored,
    and an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession)
    text = normalised(F.col(text_col))
    digest = F.col("sha") if digest_hex >= 64 else F.substring(F.hex("sha"), 1, digest_hex).cast("binary")
    rows = work.keep(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha")), "digests")
    entries, total = rows.withColumn("digest", digest), rows.count()
    index = DigestIndex(work, buckets=min(1 << 16, 1 + total // BUCKET_ROWS))
    for k in range(memtables):
        index.flush(entries.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(memtables)) == k).select("digest", "id"))
    merged = index.compact()
    hits = index.write(merged.rows.where("n > 1"), merged.level + 1)
    # Only rows that pass the hits' filter bring their bytes. Equal bodies fall together before they are shuffled,
    # so a group of copies that holds a third of all rows leaves each task as one row.
    located = docs.select(F.col(id_col).alias("id"), text.alias("body")).withColumn("sha", F.unhex(F.sha2("body", 256))).withColumn("digest", digest)
    bodies = index.screen(located, hits).groupBy("digest", "body").agg(F.min("id").alias("apart_id"), F.count("*").alias("apart_n"))
    verified = work.keep(bodies.groupBy("digest").agg(F.count("*").alias("texts")), "verified")
    checked = work.keep(hits.rows.join(verified, "digest").select("digest", F.col("id").alias("keep_id"), "n", "texts"), "checked")
    sure = checked.where("texts = 1").select("digest", "keep_id", "n")
    # Digests with more than a thousandth of the rows meet them by broadcast, the others by a shuffle on the digest.
    hot = F.col("n") * HOT_SHARE > total
    known, large = entries.select("id", "sha", "digest"), F.broadcast(sure.where(hot))
    found = known.join(large, "digest").unionByName(known.join(large.select("digest"), "digest", "left_anti").join(sure.where(~hot), "digest", "left"))
    clash = checked.where("texts > 1").select("digest")
    if not clash.isEmpty():
        apart = work.keep(located.join(clash, "digest", "left_semi").groupBy("digest", "body").agg(F.min("id").alias("apart_id"), F.count("*").alias("apart_n")), "apart")
        split = located.join(apart, ["digest", "body"]).select("id", "sha", "digest", F.col("apart_id").alias("keep_id"), F.col("apart_n").alias("n"))
        found = found.join(clash, "digest", "left_anti").unionByName(split)
    index.drop()
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
