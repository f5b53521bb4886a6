"""Joins that Spark has no single operator for, each as an equi-join plus a residual.

Time joins meet in buckets, so a key with many rows is spread over its buckets and
no task sees more than one bucket of one key at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .containment import contains_join  # noqa: F401
from .iterate import settle

#: Rows that a time range of an as-of join without a key holds on average, and the most ranges.
RANGE_ROWS, MOST_RANGES = 100_000, 8_192


def as_of_join(left: DataFrame, right: DataFrame, *, left_ts: str, right_ts: str, value: str, by: Sequence[str] = (), bucket: str = "day", default: str | None = None) -> DataFrame:
    """Adds ``value`` of the last right row at or before the left row's time, else ``default``.

    Equal times take the greatest value. Inside a bucket a window finds the last
    row; what earlier buckets hand on is one value for each (key, bucket). With
    keys a bucket is a span of time. Without keys that could put everything into
    a few tasks, so buckets then are ranges of equal size: the rows of both sides
    are range-partitioned by time once and written to the shared folder.
    """
    by = list(by)
    held = F.struct(F.col(value).alias("v"))
    sides = left.withColumns({"_t": F.col(left_ts), "_side": F.lit(1), "_held": F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType)})
    given = right.where(F.col(right_ts).isNotNull()).select(*by, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), held.alias("_held"))
    both = sides.unionByName(given, allowMissingColumns=True)
    order = ["_t", "_side", F.col("_held.v")]
    if by:
        both = both.withColumn("_bucket", F.date_trunc(bucket, "_t"))
    else:
        ranges = max(1, min(MOST_RANGES, both.count() // RANGE_ROWS))
        both = settle(both.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, "_row").withColumn("_bucket", F.spark_partition_id()))
    inside = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("_near", F.last("_held", ignorenulls=True).over(inside))
    ends = both.groupBy(*by, "_bucket").agg(F.max_by("_held", F.when(F.col("_side") == 0, F.struct("_t", F.col("_held.v")))).alias("_end"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_b"), F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    on = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = both.where("_side = 1").join(carry, on, "left")
    # A null time compares with nothing.
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_near", "_carry"))
    result = F.when(found.isNotNull(), found["v"]).otherwise(F.lit(default)) if default is not None else found["v"]
    return out.select(*left.columns, result.alias(value))


#: Bits by which a level of time cells is coarser than the one below; a span has at most 30 cells a level.
CELL_BITS = 4


def _cells(at: Column, level: Column) -> Column:
    """The cell of a level that a time, in microseconds, lies in."""
    return F.call_function("shiftright", at, (level * CELL_BITS).cast("int"))


def interval_join(calls: DataFrame, spans: DataFrame, *, key: str, at: str, start: str, end: str, span_id: str, call_id: Sequence[str], bucket: str = "day") -> DataFrame:
    """Left join of each call to the innermost span of its key that contains it: the last started, then the greatest id.

    A closed span is cut into cells of time, each sixteen times as long as those of
    the level below, as few as cover it: some dozens, whether it lasts a second or
    ten years. A cell keeps only the last started of the spans that cover it, found
    by a maximum that combines before it is shuffled; a call looks up the one cell
    of each level that it lies in. So no call meets a list of spans, however long or
    deeply nested they are. A null end is open: of the open spans only the last
    started before a call can be its innermost, which an as-of join finds.
    """
    shut = spans.where((F.col(end) >= F.col(start)) & F.col(key).isNotNull())
    shut = shut.select(F.col(key).alias("_key"), F.unix_micros(F.col(start).cast("timestamp")).alias("_lo"), (F.unix_micros(F.col(end).cast("timestamp")) + 1).alias("_hi"), F.struct(F.col(start).alias("s"), F.col(span_id).alias("i")).alias("_span"))
    # 64 bits of microseconds have 16 levels; more than that no span needs.
    level = F.explode(F.sequence(F.lit(0), F.lit(64 // CELL_BITS - 1))).alias("_level")
    up = lambda x, n: -F.call_function("shiftright", -x, n)
    by = (F.col("_level") * CELL_BITS).cast("int")
    edge = shut.select("*", level).select("*", up(F.col("_lo"), by).alias("_a"), F.call_function("shiftright", F.col("_hi"), by).alias("_b")).where("_a < _b")
    one = F.lit(CELL_BITS)
    full = lambda x: F.call_function("shiftleft", x, one)
    inner_a, inner_b = full(up(F.col("_a"), one)), full(F.call_function("shiftright", F.col("_b"), one))
    run = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
    cell = F.explode(F.concat(run(F.col("_a"), F.least(inner_a, F.col("_b"))), run(F.greatest(inner_b, inner_a), F.col("_b")))).alias("_cell")
    cells = edge.select("_key", "_level", "_span", cell).groupBy("_key", "_level", "_cell").agg(F.max("_span").alias("_last"))
    ids = [F.col(c).alias(f"_c{i}") for i, c in enumerate(call_id)]
    names = [f"_c{i}" for i in range(len(call_id))]
    asked = calls.select(*ids, F.col(key).alias("_key"), F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), level).where("_at IS NOT NULL")
    asked = asked.select(*names, "_key", "_level", _cells(F.col("_at"), F.col("_level")).alias("_cell"))
    inner = asked.join(cells, ["_key", "_level", "_cell"]).groupBy(*names).agg(F.max("_last").alias("_shut"))
    opened = spans.where(F.col(end).isNull() & F.col(start).isNotNull()).select(key, F.col(start).alias("_os"), F.struct(F.col(start).alias("s"), F.col(span_id).alias("i")).alias("_open"))
    both = as_of_join(calls, opened, left_ts=at, right_ts="_os", value="_open", by=[key], bucket=bucket)
    joined = both.join(inner, [F.col(c) == F.col(n) for c, n in zip(call_id, names, strict=True)], "left")
    return joined.select(*calls.columns, F.greatest("_shut", "_open")["i"].alias(span_id))


def followed_later(rows: DataFrame, *, key: str, at: str, is_event: Column, class_col: str, expected: dict[str, Sequence[str] | None], tool_col: str) -> DataFrame:
    """Rows with ``class_col`` set, plus ``followed``: whether the key has a later event whose tool the class expects (null: any).

    A later one exists exactly if the last one is later, so one maximum for each
    key and class replaces the comparison of all pairs.
    """
    latest = rows.where(is_event).groupBy(F.col(key).alias("_key")).agg(*[F.max(F.when(F.col(tool_col).isin(list(tools)) if tools is not None else F.lit(True), F.col(at))).alias(f"_last_{name}") for name, tools in expected.items()])
    last = F.lit(None)
    for name in expected:
        last = F.when(F.col(class_col) == name, F.col(f"_last_{name}")).otherwise(last)
    fired = rows.where(F.col(class_col).isin(list(expected)))
    joined = fired.join(latest, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("followed", F.coalesce(last > F.col(at), F.lit(False))).drop("_key", *[f"_last_{n}" for n in expected])


def rescued(blocks: DataFrame, passes: DataFrame, *, key: str, pos: str, prints: str, least: int = 2) -> DataFrame:
    """Blocks plus ``rescued``: a later pass of the key shares min(least, size) entries of the block's fingerprint.

    A pass is listed under each combination of so many of its distinct entries,
    with the key's last place for each: a block is rescued if one of its own
    combinations has a later place. So passes meet in maxima and no block is
    compared with every later pass. A block without entries needs any later pass.
    """
    own = blocks.select(F.col(key).alias("_k"), F.col(pos).alias("_p"), F.array_sort(F.array_distinct(prints)).alias("_f")).distinct()
    given = passes.select(F.col(key).alias("_k"), F.col(pos).alias("_p"), F.array_sort(F.array_distinct(prints)).alias("_f"))
    last = None
    for n in range(0, least + 1):
        part = given.select("_k", "_p", F.explode(combinations(F.col("_f"), n)).alias("_x")).groupBy("_k", "_x").agg(F.max("_p").alias("_last"))
        last = part if last is None else last.unionByName(part)
    need = F.least(F.size("_f"), F.lit(least))
    chosen = F.when(need == 0, combinations(F.col("_f"), 0))
    for n in range(1, least + 1):
        chosen = chosen.when(need == n, combinations(F.col("_f"), n))
    tries = own.select("_k", "_p", F.explode(chosen).alias("_x")).join(last, ["_k", "_x"]).where("_last > _p")
    hits = tries.select("_k", "_p").distinct().withColumn("rescued", F.lit(True))
    return blocks.join(hits, (F.col(key) == F.col("_k")) & (F.col(pos) == F.col("_p")), "left").drop("_k", "_p").withColumn("rescued", F.coalesce("rescued", F.lit(False)))


def combinations(items: Column, n: int) -> Column:
    """All combinations of ``n`` items of a sorted array, as arrays in its order; one empty array for none."""
    if n == 0:
        return F.array(F.slice(items, 1, 0))
    if n == 1:
        return F.transform(items, lambda x: F.array(x))
    shorter = combinations(items, n - 1)
    return F.flatten(F.transform(shorter, lambda c: F.transform(F.filter(items, lambda x: x > F.element_at(c, -1)), lambda x: F.concat(c, F.array(x)))))


def path_prefixes(path: Column) -> Column:
    """All directory prefixes of a path on ``/`` boundaries, the path itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def path_suffixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def longest_affix(left: DataFrame, right: DataFrame, *, path: str, affix: str, row_id: str, suffix: bool = False) -> DataFrame:
    """Inner join of each left path to the longest right path that is a prefix (or suffix) of it on ``/`` boundaries."""
    options = path_suffixes(F.col(path)) if suffix else path_prefixes(F.col(path))
    listed = left.select(row_id, path, F.explode(options).alias("_affix"))
    known = right.select(F.col(affix).alias("_affix")).where("_affix <> ''").distinct()
    hits = listed.join(known, "_affix")
    return hits.groupBy(row_id, path).agg(F.max_by("_affix", F.length("_affix")).alias(affix))


def unique_in_window(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_ts: str, right_ts: str, seconds: int, left_id: str, right_id: str) -> DataFrame:
    """Each left row with the one right row of its keys within ``seconds``; none if there are several.

    The right side is listed in its own and both neighbouring time cells, so the
    join is an equality on keys and cell.
    """
    cell = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    listed = right.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(right_ts).alias("_rt"), F.col(right_id).alias(right_id), F.explode(F.array(cell(right_ts) - 1, cell(right_ts), cell(right_ts) + 1)).alias("_cell"))
    on = (cell(left_ts) == F.col("_cell")) & (F.abs(F.unix_micros(F.col(left_ts).cast("timestamp")) - F.unix_micros(F.col("_rt").cast("timestamp"))) <= seconds * 1_000_000)
    for i, c in enumerate(by):
        on = on & (F.col(c) == F.col(f"_k{i}"))
    hits = left.select(left_id, left_ts, *by).join(listed, on)
    return hits.groupBy(left_id).agg(F.count("*").alias("_n"), F.min(right_id).alias(right_id)).where("_n = 1").drop("_n")


def merge_by_precedence(frames: Sequence[DataFrame], *, key: str, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Full outer merge on a key: each column from the first frame that has it, and ``found_by`` as the sorted names."""
    out = None
    for frame, name in zip(frames, names, strict=True):
        own = frame.select(F.col(key).alias(f"_key_{name}"), *[F.col(c).alias(f"_{c}_{name}") for c in columns if c in frame.columns], F.lit(name).alias(f"_by_{name}"))
        if out is None:
            out = own.withColumn(key, F.col(f"_key_{name}"))
        else:
            out = out.join(own, F.col(key) == F.col(f"_key_{name}"), "full_outer").withColumn(key, F.coalesce(key, f"_key_{name}"))
    picked = [F.coalesce(*[F.col(f"_{c}_{n}") for n in names if f"_{c}_{n}" in out.columns]).alias(c) for c in columns]
    found = F.array_join(F.array_sort(F.filter(F.array(*[F.col(f"_by_{n}") for n in names]), lambda x: x.isNotNull())), ",")
    return out.select(key, *picked, found.alias("found_by"))


def pair_by_id(starts: DataFrame, ends: DataFrame, *, key: str, end_order: str, end_value: str) -> DataFrame:
    """Starts with the value of their last end row, or null."""
    last = ends.groupBy(F.col(key).alias("_k")).agg(F.max_by(end_value, end_order).alias(end_value))
    return starts.join(last, F.col(key) == F.col("_k"), "left").drop("_k")
