"""Median of the slopes between all pairs of a long series, by counting inversions; no pair is ever made.

A pair with x1 < x2 has a slope below m where y - m*x falls from the first point to the second. So
the pairs below m are the inversions of y - m*x in the order of x. A grid counts them: points are cut
into blocks by x and, for each m, into ranges of y - m*x. Pairs of one range are counted by a task for
each range, pairs of one block in different ranges by a task for each block, all others from the
numbers of points in the cells of the grid.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import settle

#: Points of a block of x and of a range, on average.
CELL = 1 << 17
#: Width at which the interval that holds the result is done, relative to the result or to the middle size of drawn slopes.
PRECISION = 1e-13
#: Points whose slopes give the first guesses.
DRAWN = 4096


def inversions(values: np.ndarray) -> int:
    """Pairs with the greater value first; equal values are none. Merges of doubling width."""
    n = len(values)
    size = 1 << max(n - 1, 0).bit_length()
    a = np.arange(size)
    a[np.argsort(values, kind="stable")] = np.arange(n)
    total, w = 0, 1
    while w < size:
        halves = a.reshape(-1, 2, w)
        shift = np.arange(len(halves))[:, None]
        below = np.searchsorted((halves[:, 0] + shift * size).ravel(), (halves[:, 1] + shift * size).ravel()) - np.repeat(shift * w, w)
        total += int(w * below.size - below.sum())
        a = np.sort(a.reshape(-1, 2 * w), axis=1).ravel()
        w *= 2
    return total


def _inside(column: str):
    def count(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": rows["k"].iloc[:1], "n": [inversions(rows.sort_values("r")[column].to_numpy())]})

    return count


def pairs_below(points: DataFrame, n: int, slopes: Iterable[float]) -> list[int]:
    """For each m the pairs of points (r, block, x, y) with a slope below m; ``r`` and ``block`` follow x, then y."""
    asked = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(m)).alias("m")) for k, m in enumerate(slopes)])
    size = len(slopes)
    listed = points.withColumn("_m", F.explode(asked)).select("r", "block", F.col("_m.k").alias("k"), (F.col("y") - F.col("_m.m") * F.col("x")).alias("v"))
    # Written once, since the borders of ranges are drawn anew by each job.
    ranged = settle(listed.repartitionByRange(max(8, -(-n * size // CELL)), "k", "v", "r").withColumn("range", F.spark_partition_id()))
    total = [0] * size
    counted = [ranged.groupBy("k", key).applyInPandas(_inside(column), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")) for key, column in (("range", "v"), ("block", "range"))]
    for row in counted[0].unionByName(counted[1]).collect():
        total[row["k"]] += row["n"]
    # One row a cell of the grid: (points / CELL) squared for each m.
    cells = ranged.groupBy("k", "block", "range").count().toPandas()
    for k, own in cells.groupby("k"):
        grid = own.pivot(index="block", columns="range", values="count").fillna(0).to_numpy().astype(object if n > 1 << 30 else np.int64)
        later = np.zeros_like(grid)
        later[:, :-1] = grid[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
        before = np.zeros_like(grid)
        before[1:] = later.cumsum(axis=0)[:-1]
        total[int(k)] += int((grid * before).sum())
    return total


def median_slope(points: DataFrame, x: str, y: str, *, guesses: int = 12) -> float:
    """Median of the slopes between all pairs of points of different x; 0 with fewer than two distinct x.

    Rows with a null, NaN or infinite x or y are left out; repeated rows count as
    often as they occur, pairs of equal x have no slope. An even number of pairs
    has the mean of the two middle ones. The interval that holds the result is
    narrowed by counting the pairs below ``guesses`` slopes a round, until its ends agree to
    ``PRECISION``; differences of y - m*x that vanish in double precision limit it. A round moves ``guesses`` short rows a point twice; a task holds about ``CELL``.
    """
    real = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("abs(x) < double('Infinity') and abs(y) < double('Infinity')")
    n, mx, my = real.agg(F.count("*"), F.avg("x"), F.avg("y")).first()
    if n < 2:
        return 0.0
    salted = real.select((F.col("x") - mx).alias("x"), (F.col("y") - my).alias("y"), F.monotonically_increasing_id().alias("salt"))
    ordered = salted.repartitionByRange(max(4, -(-n // CELL)), "x", "y", "salt").sortWithinPartitions("x", "y", "salt")
    ranked = settle(ordered.select("x", "y", F.monotonically_increasing_id().alias("r"), F.spark_partition_id().alias("block")))
    same = ranked.groupBy("x").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    pairs = n * (n - 1) // 2 - same
    if pairs == 0:
        return 0.0
    drawn = ranked.select("x", "y", "r").orderBy(F.xxhash64("r"), "r").limit(DRAWN).toPandas()
    i, j = np.triu_indices(min(len(drawn), 256), 1)
    i, j = np.concatenate([i, np.arange(len(drawn) - 1)]), np.concatenate([j, np.arange(1, len(drawn))])
    dx, dy = (drawn[c].to_numpy()[i] - drawn[c].to_numpy()[j] for c in "xy")
    found = np.sort(dy[dx != 0] / dx[dx != 0]) if (dx != 0).any() else np.array([0.0])
    size = np.abs(found[found != 0])
    scale = float(np.median(size)) if len(size) else 0.0
    known: dict[float, int] = {}

    def ask(slopes: np.ndarray) -> None:
        new = sorted({float(m) for m in slopes} - known.keys())
        if new:
            known.update(zip(new, pairs_below(ranked, n, new), strict=True))

    ask(np.quantile(found, np.linspace(0.4, 0.6, guesses)))

    def select(k: int) -> float:
        step = max(float(found[-1] - found[0]), abs(float(found[0])), 1e-300)
        while True:
            lo, hi = max((m for m, c in known.items() if c <= k), default=None), min((m for m, c in known.items() if c > k), default=None)
            if lo is None or hi is None:
                ask((hi - step * 16.0 ** np.arange(-guesses // 2, guesses // 2)) if lo is None else (lo + step * 16.0 ** np.arange(-guesses // 2, guesses // 2)))
                step *= 16.0 ** (guesses // 2)
                continue
            width = hi - lo
            if width <= PRECISION * max(abs(lo), abs(hi), scale) or np.nextafter(lo, hi) >= hi or width < 1e-300:
                # A slope that many pairs share is among those drawn, and is given as it is.
                shared = found[(found >= lo) & (found <= hi)]
                return float(shared[0]) if len(shared) else lo + width / 2
            near = lo + width * (k + 0.5 - known[lo]) / max(known[hi] - known[lo], 1)
            third = max(guesses // 3, 1)
            inner = width * 10.0 ** -np.linspace(1, min(12, third), third)
            tried = np.concatenate([lo + width * np.linspace(0, 1, third + 2)[1:-1], near - inner, near + inner])
            tried = tried[(tried > lo) & (tried < hi)]
            ask(tried if len(tried) else np.array([lo + width / 2]))

    return (select((pairs - 1) // 2) + select(pairs // 2)) / 2
