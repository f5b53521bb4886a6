"""Structure of a source tree and its growth: metrics, rules, findings, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import sens_slope
from ..functions.text import glob_regex
from ..operators import graph as G


def measure(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value): modules, dependencies, propagation_cost, cycles, modules_in_cycles."""
    m = modules.select(F.col("path").alias("node")).distinct()
    e = edges.select("src", "dst").distinct()
    reach = G.closure(e, m)
    rings = G.strong_components(reach)
    one = m.agg(F.count("*").alias("modules")).join(e.agg(F.count("*").alias("dependencies"))).join(reach.agg(F.count("*").alias("pairs"))).join(rings.agg(F.count_distinct("component").alias("cycles"), F.count("*").alias("modules_in_cycles")))
    cost = F.try_divide(F.col("pairs").cast("double"), F.col("modules") * F.col("modules"))
    listed = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in (("modules", F.col("modules")), ("dependencies", F.col("dependencies")), ("propagation_cost", cost), ("cycles", F.col("cycles")), ("modules_in_cycles", F.col("modules_in_cycles")))])
    return one.select(F.explode(listed).alias("x")).select("x.metric", "x.value")


def layers(modules: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(path, layer): the first pattern that matches; null for none. Patterns are (layer, glob), an authored short list."""
    layer = F.coalesce(*[F.when(F.col("path").rlike(glob_regex(g)), F.lit(name)) for name, g in patterns]) if patterns else F.lit(None).cast("string")
    return modules.select("path", layer.alias("layer"))


def rule_violations(edges: DataFrame, layered: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Edges between layers that no allowed pair names."""
    a, b = layered.select(F.col("path").alias("src"), F.col("layer").alias("from_layer")), layered.select(F.col("path").alias("dst"), F.col("layer").alias("to_layer"))
    ok = F.lit(False)
    for x, y in allowed:
        ok = ok | ((F.col("from_layer") == x) & (F.col("to_layer") == y))
    return edges.join(a, "src").join(b, "dst").where("from_layer <> to_layer").where(~ok).select("src", "dst", "from_layer", "to_layer")


def findings(modules: DataFrame, edges: DataFrame, patterns: list[tuple[str, str]], allowed: list[tuple[str, str]]) -> DataFrame:
    """(category, subject): rings, forbidden edges, modules in no layer, patterns that match nothing."""
    layered = layers(modules, patterns)
    rings = G.strong_components(G.closure(edges)).groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("node")), " ").alias("subject"))
    spark = modules.sparkSession
    named = spark.createDataFrame([(n, g, glob_regex(g)) for n, g in patterns], "layer string, pattern string, regex string")
    stale = named.join(modules.select("path"), F.expr("path rlike regex"), "left_anti")
    out = rings.select(F.lit("cycle").alias("category"), "subject")
    out = out.unionByName(rule_violations(edges, layered, allowed).select(F.lit("rule").alias("category"), F.concat_ws(" -> ", "src", "dst").alias("subject")))
    out = out.unionByName(layered.where("layer IS NULL").select(F.lit("unplaced").alias("category"), F.col("path").alias("subject")))
    return out.unionByName(stale.select(F.lit("stale-pattern").alias("category"), F.col("pattern").alias("subject")))


def scan_diff(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(metric, before, after) of two scans (modules, edges)."""
    return G.metric_diff(measure(*old), measure(*new))


def series(vertices: DataFrame) -> DataFrame:
    """(day, n, total): vertices ingested by day and so far."""
    d = vertices.where("ingested_at IS NOT NULL").groupBy(F.to_date("ingested_at").alias("day")).agg(F.count("*").alias("n"))
    return d.withColumn("total", F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("day").rowsBetween(W.unboundedPreceding, 0)))


def headline(days: DataFrame, window: int = 30) -> DataFrame:
    """(span, slope): growth by day over all days and over those within ``window`` of the last."""
    x = days.select(F.unix_date("day").cast("double").alias("x"), F.col("total").cast("double").alias("y"))
    near = x.withColumn("_m", F.max("x").over(W.partitionBy(F.lit(1)))).where(F.col("x") >= F.col("_m") - window).drop("_m")
    return sens_slope(x, "x", "y").select(F.lit("all").alias("span"), "slope").unionByName(sens_slope(near, "x", "y").select(F.lit("recent").alias("span"), "slope"))


def split_artifacts(artifacts: DataFrame) -> DataFrame:
    """(repo, path, spellings): one file under several identifiers."""
    g = artifacts.where("coalesce(repo, '') <> '' AND coalesce(path, '') <> ''").groupBy("repo", "path").agg(F.array_sort(F.collect_set("identifier")).alias("spellings"))
    return g.where("size(spellings) > 1")


def retired(vertices: DataFrame, edges: DataFrame, marks: Column) -> tuple[DataFrame, DataFrame]:
    """(doomed, survivors): the vertices that a test marks, and their neighbours with the edges they lose."""
    doomed = vertices.where(marks).select("vid").distinct()
    return doomed, G.neighbours(doomed, edges)
