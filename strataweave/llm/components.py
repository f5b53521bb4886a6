"""Connected components of an edge table by local union and repeated contraction.

Each round deals the edges into tasks of ``EDGES_PER_TASK``; a task joins what its
own edges connect and leaves one star for each piece. If more than one task took
part, every vertex then moves to the neighbour (or itself) whose hash is least,
edges are renamed to those targets and loops dropped, so the graph shrinks by a
constant factor a round. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

EDGES_PER_TASK = 500_000


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex of its component) of every vertex of an edge list."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(names))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return names, names[label]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not (label[label] == label).all():
            label = label[label]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if held:
        node, root = local_stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "to"])


def components(edges: DataFrame, work: Workspace, name: str, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, component) for every vertex of ``edges`` (u, v longs); component is its least vertex.

    Loops and repeated edges are harmless; an empty edge table gives an empty result.
    """
    live = edges.select("u", "v").where("u <> v")
    mapping, round_ = None, 0
    while tasks := -(-live.count() // per_task):
        stars = work.keep(live.repartition(tasks).mapInArrow(_stars, "node long, to long"), f"{name}-stars-{round_}")
        parent, following = stars, None
        if tasks > 1:
            pairs = stars.where("node <> to").select(F.col("node").alias("u"), F.col("to").alias("v"))
            both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
            best = both.groupBy("u").agg(F.min(F.xxhash64(F.lit(round_), "v")).alias("h"), F.min_by("v", F.xxhash64(F.lit(round_), F.col("v"))).alias("v"))
            own = F.xxhash64(F.lit(round_), F.col("u"))
            parent = work.keep(best.select(F.col("u").alias("node"), F.when(F.col("h") < own, F.col("v")).otherwise(F.col("u")).alias("to")), f"{name}-parent-{round_}")
            step = pairs.join(parent.select(F.col("node").alias("u"), F.col("to").alias("pu")), "u")
            step = step.select("pu", "v").distinct().join(parent.select(F.col("node").alias("v"), F.col("to").alias("pv")), "v")
            following = work.keep(step.where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), f"{name}-edges-{round_ + 1}")
        if mapping is None:
            mapping = parent
        else:
            moved = mapping.join(parent.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
            mapping = work.keep(moved.select("node", F.coalesce("next", "to").alias("to")), f"{name}-map-{round_}")
        if following is None:
            break
        live, round_ = following, round_ + 1
    if mapping is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if round_ == 0:
        return mapping.withColumnRenamed("to", "component")
    least = work.keep(mapping.groupBy("to").agg(F.min("node").alias("component")), f"{name}-least")
    return work.keep(mapping.join(least, "to").select("node", "component"), name)
