"""The graph on Parquet: versioned tables, keyed upserts, named snapshots."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGE, TERMINAL_STATUS, VERTEX


class GraphUnavailable(RuntimeError):
    """The store's folder holds no graph."""


@dataclass
class Graph:
    vertices: DataFrame
    edges: DataFrame


def _write_order(new: DataFrame, order: str | None) -> Column:
    """What tells the later of two writes of one key: the given column, then the whole row, so reruns agree."""
    flat = [F.to_json(F.struct(F.col(f.name))) if f.dataType.typeName() == "map" else F.col(f.name) for f in new.schema]
    return F.struct(*([F.col(order)] if order else []), *flat)


def upsert_vertices(old: DataFrame, new: DataFrame, *, hold_first: tuple[str, ...] = (), never_lower: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Keyed merge on vid: new non-null values win, except that held columns keep their first non-empty value and
    ``never_lower`` ones take the greater (a tier may only fall in trust).

    Of several new rows for a key the one that is last by the column ``order``
    wins, value by value; rows equal in it are ordered by their values.
    """
    at = _write_order(new, order)

    def won(c: str) -> Column:
        x = F.col(c)
        if c in never_lower:
            return F.max(x)
        if c in hold_first:
            return F.coalesce(F.min_by(x, F.when(x != "", at)), F.max_by(x, F.when(x.isNotNull(), at)))
        return F.max_by(x, F.when(x.isNotNull(), at))

    one = new.groupBy("vid").agg(*[won(c).alias(c) for c in new.columns if c not in ("vid", order)])
    names = [c for c in old.columns if c != "vid"]
    a, b = old.alias("a"), one.alias("b")
    joined = a.join(b, F.col("a.vid") == F.col("b.vid"), "full_outer")

    def merged(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}") if c in one.columns else F.lit(None)
        if c in hold_first:
            return F.coalesce(F.when(x != "", x), y, x)
        if c in never_lower:
            return F.greatest(x, y)
        return F.coalesce(y, x)

    return joined.select(F.coalesce("a.vid", "b.vid").alias("vid"), *[merged(c).alias(c) for c in names])


def upsert_edges(old: DataFrame, new: DataFrame, *, order: str | None = None) -> DataFrame:
    """Keyed merge on (label, src, dst); properties of the new edge overwrite those of the old, the last write by ``order`` first."""
    key = ["label", "src", "dst"]
    at = _write_order(new, order)
    one = new.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in ("src_label", "dst_label", "props")])
    a, b = old.alias("a"), one.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full_outer")
    empty = F.create_map().cast("map<string,string>")
    x, y = F.coalesce("a.props", empty), F.coalesce("b.props", empty)
    kept = F.map_filter(x, lambda k, v: ~F.array_contains(F.map_keys(y), k))
    props = F.when(F.col("a.props").isNull() & F.col("b.props").isNull(), F.lit(None)).otherwise(F.map_concat(kept, y))
    return joined.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in (*key, "src_label", "dst_label")], props.alias("props"))


def stamped(new: DataFrame, old: DataFrame, text: Column, now: Column) -> DataFrame:
    """Adds text_digest and written_at; the time stays while the text does."""
    digest = F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)
    held = old.select("vid", F.col("text_digest").alias("_d"), F.col("written_at").alias("_w"))
    out = new.drop("text_digest", "written_at").withColumn("text_digest", digest).join(held, "vid", "left")
    return out.withColumn("written_at", F.when(F.col("_d") == F.col("text_digest"), F.coalesce("_w", now)).otherwise(now)).drop("_d", "_w")


def source_conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a source upsert refuses: a rise in trust, another origin."""
    j = old.alias("a").join(new.alias("b"), "vid")
    rise = F.when(F.col("b.tier") < F.col("a.tier"), F.format_string("tier %d does not rise to %d", F.col("a.tier"), F.col("b.tier")))
    moved = F.when((F.col("a.origin") != "") & (F.col("b.origin") != F.col("a.origin")), F.concat(F.lit("origin stays "), F.col("a.origin")))
    return j.select("vid", F.explode(F.filter(F.array(rise, moved), lambda x: x.isNotNull())).alias("conflict"))


def apply_thread_refs(threads: DataFrame, refs: DataFrame, *, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(thread updates, edges) of refs (session, thread, status) to threads that exist; the last by ``order`` sets the status."""
    known = refs.join(threads.where("label = 'Thread'").select(F.col("vid").alias("thread")), "thread", "left_semi")
    update = known.groupBy(F.col("thread").alias("vid")).agg(F.max_by("status", _write_order(refs, order)).alias("status"))
    label = F.when(F.col("status").isin(*TERMINAL_STATUS), "RESOLVES").otherwise("CONTINUES")
    edges = known.select(label.alias("label"), F.col("session").alias("src"), F.col("thread").alias("dst"), F.lit("Session").alias("src_label"), F.lit("Thread").alias("dst_label"), F.lit(None).cast("map<string,string>").alias("props"))
    return update, edges


def remove_vertices(graph: Graph, doomed: DataFrame) -> Graph:
    """Without the doomed vertices and every edge at one of them."""
    d = doomed.select("vid").distinct()
    edges = graph.edges.join(d.withColumnRenamed("vid", "src"), "src", "left_anti").join(d.withColumnRenamed("vid", "dst"), "dst", "left_anti")
    return Graph(graph.vertices.join(d, "vid", "left_anti"), edges.select(*graph.edges.columns))


def content_digest(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table, whatever its order and partitioning."""
    flat = [F.to_json(F.struct(F.col(f.name))) if f.dataType.typeName() in ("map", "struct", "array") else F.col(f.name) for f in sorted(df.schema, key=lambda f: f.name)]
    h = F.xxhash64(*flat)
    return df.agg(F.count("*").alias("rows"), F.hex(F.coalesce(F.bit_xor(h), F.lit(0))).alias("digest"))


def reduced_edges(new: DataFrame, key: list[str], at: Column) -> DataFrame:
    """One row an edge: later writes set their properties over those of earlier ones. A write counts once, so a list holds as many maps as writes."""
    order = F.array_sort(F.collect_list(F.when(F.col("props").isNotNull(), F.struct(at.alias("at"), F.map_entries("props").alias("own")))))
    empty = F.create_map().cast("map<string,string>")
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)
    props = F.aggregate(order, empty, lambda acc, w: over(acc, F.map_from_entries(w["own"])))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return new.groupBy(*key).agg(last("src_label"), last("dst_label"), F.when(F.count("props") > 0, props).alias("props"))


class DeltaStore:
    """A graph whose writes are small: each appends one delta, and a read merges deltas over the last compacted tables.

    ``base-<n>`` and ``delta-<n>`` are folders of two Parquet tables, laid out by a
    bucket of the key (of an edge its source). A folder counts once its ``DONE``
    marker is there, written last, so readers never see half a write and a write
    that failed is no write. Reads take the newest base and the deltas after it.
    ``compact`` makes both one base; it is due after ``DELTAS`` writes and leaves
    old folders to readers that still use them, until ``vacuum``.
    """

    DELTAS = 16

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 64, hold_first: tuple[str, ...] = (), never_lower: tuple[str, ...] = ()):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.rules = {"hold_first": hold_first, "never_lower": never_lower}

    def _at(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _parts(self) -> tuple[int, list[int]]:
        """The newest complete base, and the complete deltas after it."""
        fs, top = self._at("")
        done = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        done = [n for n in done if "-" in n and fs.exists(self._at(f"{n}/DONE")[1])]
        base = max((int(n[5:]) for n in done if n.startswith("base-")), default=-1)
        return base, sorted(k for n in done if n.startswith("delta-") and (k := int(n[6:])) > base)

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _put(self, name: str, vertices: DataFrame | None, edges: DataFrame | None) -> None:
        fs, folder = self._at(name)
        fs.delete(folder, True)  # what a failed write of this number has left
        for kind, df, key in (("vertices", vertices, "vid"), ("edges", edges, "src")):
            if df is not None:
                df.withColumn("bucket", self._bucket(key)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/{kind}")
        fs.create(self._at(f"{name}/DONE")[1]).close()

    def _next(self) -> int:
        base, deltas = self._parts()
        return max([base, *deltas]) + 1

    def create(self, graph: Graph) -> int:
        """A whole graph of unique keys as the base that later deltas change."""
        n = self._next()
        self._put(f"base-{n}", graph.vertices.select(*VERTEX.names), graph.edges.select(*EDGE.names))
        return n

    def append(self, vertices: DataFrame | None = None, edges: DataFrame | None = None, *, order: str | None = None) -> int:
        """Write a delta and return its number; it has one file for each bucket that its keys fall into. Columns may be missing: they keep their values."""
        n = self._next()
        # Within a delta the row that is last by ``order`` wins; whole numbers and times keep their order.
        at = F.lit(None).cast("long") if order is None else F.col(order).cast("long")
        rows = None if vertices is None else vertices.withColumn("_at", at).drop(*([order] if order else []))
        self._put(f"delta-{n}", rows, None if edges is None else edges.select(*EDGE.names))
        return n

    def _table(self, name: str, kind: str) -> DataFrame | None:
        fs, folder = self._at(f"{name}/{kind}")
        return self.spark.read.option("basePath", f"{self.path}/{name}/{kind}").parquet(folder.toString()) if fs.exists(folder) else None

    def read(self, vids: list[str] | None = None) -> Graph:
        """The merged graph; with ``vids`` these vertices and the edges that leave them, from their buckets' files alone."""
        base, deltas = self._parts()
        empty = Graph(self.spark.createDataFrame([], VERTEX), self.spark.createDataFrame([], EDGE))
        buckets = None if vids is None else [r[0] for r in self.spark.createDataFrame([(v,) for v in vids], "vid string").select(self._bucket("vid")).distinct().collect()]

        def some(df: DataFrame | None, key: str) -> DataFrame | None:
            if df is None:
                return None
            near = df if buckets is None else df.where(F.col("bucket").isin(buckets) & F.col(key).isin(vids))
            return near.drop("bucket")

        v = some(self._table(f"base-{base}", "vertices"), "vid") if base >= 0 else None
        e = some(self._table(f"base-{base}", "edges"), "src") if base >= 0 else None
        v, e = v if v is not None else empty.vertices, e if e is not None else empty.edges
        new_v = [(n, d) for n in deltas if (d := some(self._table(f"delta-{n}", "vertices"), "vid")) is not None]
        new_e = [(n, d) for n in deltas if (d := some(self._table(f"delta-{n}", "edges"), "src")) is not None]
        if new_v:
            union = None
            for n, d in new_v:
                d = d.withColumn("_write", F.struct(F.lit(n).alias("n"), F.col("_at"))).drop("_at")
                union = d if union is None else union.unionByName(d, allowMissingColumns=True)
            v = upsert_vertices(v, union, order="_write", **self.rules)
        if new_e:
            key = ["label", "src", "dst"]
            union = None
            for n, d in new_e:
                d = d.withColumn("_n", F.lit(n))
                union = d if union is None else union.unionByName(d)
            one = reduced_edges(union, key, F.struct("_n", F.to_json("props").alias("p")))
            e = upsert_edges(e, one.select(*EDGE.names))
        return Graph(v.select(*VERTEX.names), e.select(*EDGE.names))

    def compact(self) -> int:
        """Merge what there is into a new base and return its number; a reader sees the old parts until it is complete."""
        n = self._next()
        whole = self.read()
        self._put(f"base-{n}", whole.vertices, whole.edges)
        return n

    def write(self, vertices: DataFrame | None = None, edges: DataFrame | None = None, *, order: str | None = None) -> Graph:
        """``append``, and ``compact`` where it is due."""
        self.append(vertices, edges, order=order)
        if len(self._parts()[1]) >= self.DELTAS:
            self.compact()
        return self.read()

    def vacuum(self) -> list[str]:
        """Delete what no new reader takes, and return its names."""
        fs, top = self._at("")
        base, _ = self._parts()
        old = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(top)) if n.startswith(("base-", "delta-")) and int(n.split("-")[1]) < base)
        for name in old:
            fs.delete(self._at(name)[1], True)
        return old


class GraphStore:
    """Versions ``v<n>`` of two Parquet tables under one folder, and a pointer file that names the current one.

    A version is complete before the pointer moves, so readers never see half a
    write. Vertices are laid out by label and scope, edges by label.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _current(self) -> str:
        """The version that the pointer names; between the two renames that move it, the old pointer still answers."""
        for name in ("CURRENT", "CURRENT.old"):
            fs, p = self._fs(name)
            if fs.exists(p):
                return self.spark.read.text(f"{self.path}/{name}").first()[0]
        raise GraphUnavailable(f"no graph at {self.path}")

    def create(self) -> Graph:
        return self.replace(Graph(self.spark.createDataFrame([], VERTEX), self.spark.createDataFrame([], EDGE)))

    def read(self, version: str | None = None) -> Graph:
        at = f"{self.path}/{version or self._current()}"
        return Graph(self.spark.read.schema(VERTEX).parquet(f"{at}/vertices"), self.spark.read.schema(EDGE).parquet(f"{at}/edges"))

    def replace(self, graph: Graph) -> Graph:
        fs, _ = self._fs("CURRENT")
        n = 0
        while fs.exists(self._fs(f"v{n}")[1]):
            n += 1
        at = f"{self.path}/v{n}"
        graph.vertices.select(*VERTEX.names).write.partitionBy("label", "scope").parquet(f"{at}/vertices")
        graph.edges.select(*EDGE.names).write.partitionBy("label").parquet(f"{at}/edges")
        self._point(f"v{n}")
        return self.read()

    def _point(self, version: str) -> None:
        fs, target = self._fs("CURRENT")
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/CURRENT.next")
        old = self._fs("CURRENT.old")[1]
        if fs.exists(target):
            fs.delete(old, True)
            fs.rename(target, old)
        fs.rename(self._fs("CURRENT.next")[1], target)

    def write(self, vertices: DataFrame | None = None, edges: DataFrame | None = None, **rules) -> Graph:
        """Upsert deltas; writing the same deltas twice leaves the same graph."""
        now = self.read()
        v = now.vertices if vertices is None else upsert_vertices(now.vertices, vertices, **rules)
        e = now.edges if edges is None else upsert_edges(now.edges, edges)
        return self.replace(Graph(v, e))

    def remove(self, doomed: DataFrame) -> Graph:
        return self.replace(remove_vertices(self.read(), doomed))

    def snapshot(self, name: str, *, taken_at: str, note: str = "") -> dict:
        """Register the current version under a name that must be new."""
        if any(r["name"] == name for r in self.registry()):
            raise ValueError(f"snapshot {name} exists")
        version, graph = self._current(), self.read()
        (nv, dv), (ne, de) = content_digest(graph.vertices).first(), content_digest(graph.edges).first()
        row = {"name": name, "taken_at": taken_at, "version": version, "vertices": nv, "edges": ne, "digest": f"{dv}-{de}", "note": note}
        self.spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/snapshots")
        return row

    def registry(self) -> list[dict]:
        fs, p = self._fs("snapshots")
        return [json.loads(r[0]) for r in self.spark.read.text(f"{self.path}/snapshots").collect()] if fs.exists(p) else []

    def verify(self, name: str) -> bool:
        row = next(r for r in self.registry() if r["name"] == name)
        graph = self.read(row["version"])
        (nv, dv), (ne, de) = content_digest(graph.vertices).first(), content_digest(graph.edges).first()
        return (nv, ne, f"{dv}-{de}") == (row["vertices"], row["edges"], row["digest"])

    def restore(self, name: str, *, taken_at: str) -> Graph:
        """Point at a snapshot again, after registering what was current."""
        row = next(r for r in self.registry() if r["name"] == name)
        if not self.verify(name):
            raise ValueError(f"snapshot {name} does not match its digest")
        self.snapshot(f"before-{name}-{taken_at}", taken_at=taken_at, note="safety copy")
        self._point(row["version"])
        return self.read()
