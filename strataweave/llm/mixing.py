"""Mixing sources to target weights by weighted fair queueing; native DataFrame operations only.

All running totals here come from one form of global range sort: rows are range-
partitioned by their full order, which ends in a row number, so that any number of
ties is split over tasks; each range's total gives the offset of the next ones, and
only the rows of one range are summed in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .workspace import Workspace

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Rows that one range holds on average, and the most ranges. Beyond that ranges grow, and their sorts spill;
#: the table of offsets, which one task sums, never has more rows than ranges and sources together.
BUCKET_ROWS = 16_384
MOST_RANGES = 8192


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, rows: int, order: Sequence[str], values: dict[str, str], work: Workspace, name: str, *, group: str | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Adds, for each ``out: value``, the sum of value over earlier rows in ``order`` (of the same group), as ``out``.

    ``order`` should tell all rows apart. ``extra`` (one row a group, led by the
    group's column) joins the offsets first, which are few, so its columns reach
    every row without a join on the group's name.
    """
    ranges = max(1, min(MOST_RANGES, -(-rows // BUCKET_ROWS)))
    key = [group] if group else []
    ranged = work.keep(df.repartitionByRange(ranges, *key, *order).withColumn("_range", F.spark_partition_id()), f"{name}-ranges", rows=rows)
    totals = ranged.groupBy(*key, "_range").agg(*[F.sum(v).alias(o) for o, v in values.items()])
    before = W.partitionBy(*key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias("_group") for c in key], F.col("_range").alias("_at"), *[F.coalesce(F.sum(o).over(before), F.lit(0)).alias(f"_{o}") for o in values])
    if extra is not None:
        own = extra.withColumnRenamed(group, "_name")
        offsets = offsets.join(own, F.col("_group").eqNullSafe(F.col("_name"))).drop("_name")
    offsets = work.keep(offsets, f"{name}-offsets", rows=rows)
    inside = W.partitionBy(*key, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.withColumns({o: F.coalesce(F.sum(v).over(inside), F.lit(0)) for o, v in values.items()})
    match = F.col("_range") == F.col("_at")
    if group:
        match = match & F.col(group).eqNullSafe(F.col("_group"))
    out = summed.join(offsets, match)
    return out.withColumns({o: F.col(o) + F.col(f"_{o}") for o in values}).drop("_range", "_at", "_group", *[f"_{o}" for o in values])


def fill_targets(sources: DataFrame, work: Workspace, *, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target): the total shared by weight, none above ``repeats`` times its size, the excess reshared.

    Sources rank by code point, null last, and take the weights in turn. With the
    sources in order of cap / weight, the share per weight left for the k-th and
    later ones is (total - caps before) / (weights from k on); the first k whose
    ratio reaches that share sets the level for all that are not capped.
    """
    count, total = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    named = sources.select("source", "source_size", F.col("source").isNull().alias("last"), F.encode("source", "utf-8").alias("code"), F.lit(1).alias("one"))
    ranked = running(named, count, ["last", "code"], {"rank": "one"}, work, "rank")
    cycle = F.array(*[F.lit(int(x)) for x in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * repeats)
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = work.keep(running(ranked, count, ["ratio", "last", "code"], {"caps": "cap", "weights": "weight"}, work, "fill"), "filled", rows=count)
    every = filled.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    share = (F.lit(total) - F.col("caps")) / (F.lit(every) - F.col("weights"))
    level = filled.where(F.col("ratio") >= share).agg(F.min_by(share, F.struct("ratio", "last", "code"))).first()[0]
    uncapped = F.lit(float("inf")) if level is None else F.lit(float(level)) * F.col("weight")
    return filled.select("source", "source_size", F.least(F.col("cap").cast("double"), uncapped).alias("target"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per input row.

    Each source is a queue of its documents in a seeded hash order, passed up to
    ``repeats`` times. A copy's virtual finish time is the source's words up to
    its end divided by the source's target; all copies are range-sorted by it and
    leave until the budget (all words) is spent, so every source ends within a
    document of its target. Ties break by source, then by the hash of id and text;
    rows that are equal in id and text are alike, so reruns agree. Documents
    without words, null and empty texts take part with size 0 and no copies. A
    null source is a source of its own, ranked last; null and repeated ids are
    allowed. An empty table gives no rows. With ``carry`` a column ``input`` holds
    each row's own columns as a struct, whatever their names.
    """
    work = Workspace(docs.sparkSession)
    own = [F.struct(*[F.col(c) for c in docs.columns]).alias("input")] if carry else []
    text = F.col(text_col).cast("string")
    draw = F.xxhash64(F.lit(seed), F.col(id_col), text)
    full = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), draw.alias("draw"), *own)
    # A number for each row: rows that repeat an id stay apart.
    full = work.keep(full.withColumn("row", F.monotonically_increasing_id()), "sizes")
    rows = full.drop("input")
    total, budget = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = work.keep(fill_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), work, weights=weights, repeats=repeats), "targets", rows=total)
    queued = running(rows, total, ["draw", "doc_id", "size", "row"], {"before": "size"}, work, "queue", group="source", extra=targets)
    queued = work.keep(queued, "queued", rows=total)
    passes = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn")
    copies = queued.where("size > 0").select("source", "size", "draw", "doc_id", "row", "source_size", "target", "before", passes)
    begun = F.col("turn") * F.col("source_size") + F.col("before")
    # At finish time 1 every queue has served its target; a document more may follow.
    copies = copies.where(begun < F.col("target") + F.col("size")).withColumn("finish", (begun + F.col("size")) / F.col("target"))
    copies = copies.select("finish", "source", "draw", "doc_id", "size", "row", "turn")
    timed = running(copies, 2 * total, ["finish", "source", "draw", "doc_id", "row", "turn"], {"spent": "size"}, work, "times")
    chosen = work.keep(timed.where(F.col("spent") + F.col("size") <= F.lit(budget)).groupBy("row").agg(F.count("*").alias("copies")), "chosen", rows=total)
    out = queued.join(chosen, "row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)).cast("int"))
    if carry:
        out = out.join(full.select("row", "input"), "row")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "row", *(["input"] if carry else []))
