"""A fluent, read-only graph traversal that is one DataFrame plan.

``T(graph).V().has_label("Claim").out("ABOUT").values("name")`` joins and filters;
nothing runs until ``df`` or ``to_list`` is used. Traversers at the same place
with the same history are one row with a ``bulk``, merged between hops, so a walk
costs by places and not by paths. There is no step that writes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.store import Graph
from .iterate import settle, settle_by

# Limits of the ad-hoc surface.
MAX_ROWS, MAX_CHARS, MAX_QUERY, MAX_VALUE = 50, 8_000, 2_000, 400

#: A ``repeat`` goes over a table of its steps after so many rounds, or at once with more than so many rows.
WALK, MANY = 8, 100_000
#: Rounds before the steps of such a table double their reach.
WALK_ON = 32
ROWS_A_BUCKET = 500_000


class P:
    """Predicates over one column."""

    def __init__(self, test: Callable[[Column], Column]):
        self.test = test

    def __and__(self, other: P) -> P:
        return P(lambda c: self.test(c) & other.test(c))

    def __or__(self, other: P) -> P:
        return P(lambda c: self.test(c) | other.test(c))

    def negate(self) -> P:
        return P(lambda c: ~self.test(c))


eq = lambda x: P(lambda c: c == x)
neq = lambda x: P(lambda c: c != x)
lt = lambda x: P(lambda c: c < x)
lte = lambda x: P(lambda c: c <= x)
gt = lambda x: P(lambda c: c > x)
gte = lambda x: P(lambda c: c >= x)
inside = lambda a, b: P(lambda c: (c > a) & (c < b))
outside = lambda a, b: P(lambda c: (c < a) | (c > b))
between = lambda a, b: P(lambda c: (c >= a) & (c < b))
within = lambda *xs: P(lambda c: c.isin(list(xs)))
without = lambda *xs: P(lambda c: ~c.isin(list(xs)))
containing = lambda x: P(lambda c: c.contains(x))
starting_with = lambda x: P(lambda c: c.startswith(x))
ending_with = lambda x: P(lambda c: c.endswith(x))
matching = lambda x: P(lambda c: c.rlike(x))


def _test(value) -> Callable[[Column], Column]:
    return value.test if isinstance(value, P) else lambda c: c == value


def _edge_key() -> Column:
    return F.concat_ws("\u0001", "label", "src", "dst")


class T:
    """A traversal: ``df`` has cur (place or value), bulk, and any carried path, labels, loop count and sack.

    Inside a filter or a local step, ``starts`` holds the places that the walk set out from.
    """

    def __init__(self, graph: Graph, df: DataFrame | None = None, kind: str = "", carry: tuple[str, ...] = (), starts: DataFrame | None = None):
        self.graph, self.frame, self.kind, self.carry, self.starts = graph, df, kind, carry, starts

    # Starts ---------------------------------------------------------------
    def V(self, *ids: str) -> T:
        v = self.graph.vertices.select(F.col("vid").alias("cur"))
        return self._with(v.where(F.col("cur").isin(list(ids))) if ids else v, "vertex")

    def E(self) -> T:
        return self._with(self.graph.edges.select(_edge_key().alias("cur")), "edge")

    def inject(self, *values) -> T:
        spark = self.graph.vertices.sparkSession
        return self._with(spark.createDataFrame([(x,) for x in values], ["cur"]), "value")

    def _with(self, df: DataFrame, kind: str) -> T:
        return T(self.graph, df.withColumn("bulk", F.lit(1).cast("long")), kind)

    def _next(self, df: DataFrame, kind: str | None = None, carry: tuple[str, ...] | None = None) -> T:
        return T(self.graph, df, self.kind if kind is None else kind, self.carry if carry is None else carry, self.starts)

    def _merged(self) -> DataFrame:
        return self.frame.groupBy("cur", *self.carry).agg(F.sum("bulk").alias("bulk"))

    # Properties and filters -------------------------------------------------
    def _look(self, columns: dict[str, Column]) -> DataFrame:
        """The frame joined to columns of the elements it stands on."""
        if self.kind == "edge":
            source = self.graph.edges.select(_edge_key().alias("_id"), *[c.alias(n) for n, c in columns.items()])
        else:
            source = self.graph.vertices.select(F.col("vid").alias("_id"), *[c.alias(n) for n, c in columns.items()])
        return self.frame.join(source, F.col("cur") == F.col("_id")).drop("_id")

    def _property(self, key: str) -> Column:
        if self.kind != "edge":
            return F.col({"id": "vid"}.get(key, key))
        return F.col(key) if key in ("label", "src", "dst") else F.try_element_at("props", F.lit(key))

    def has(self, key: str, value=None) -> T:
        test = (lambda c: c.isNotNull()) if value is None else _test(value)
        if self.kind == "value":
            raise TypeError("has() needs elements")
        return self._next(self._look({"_p": self._property(key)}).where(test(F.col("_p"))).drop("_p"))

    def has_not(self, key: str) -> T:
        return self._next(self._look({"_p": self._property(key)}).where("_p IS NULL").drop("_p"))

    def has_label(self, *labels: str) -> T:
        return self.has("label", within(*labels))

    def has_id(self, *ids: str) -> T:
        return self._next(self.frame.where(F.col("cur").isin(list(ids))))

    def is_(self, value) -> T:
        return self._next(self.frame.where(_test(value)(F.col("cur"))))

    def _reached(self, sub: Callable[[T], T]) -> DataFrame:
        """Places from which a sub-traversal yields something; each place is tried once."""
        starts = self.frame.select("cur").distinct()
        probe = T(self.graph, starts.withColumns({"bulk": F.lit(1).cast("long"), "_start": F.col("cur")}), self.kind, ("_start",), starts.select(F.col("cur").alias("_start")))
        return sub(probe).frame.select(F.col("_start").alias("_hit")).distinct()

    def where(self, sub: Callable[[T], T]) -> T:
        return self._next(self.frame.join(self._reached(sub), F.col("cur").eqNullSafe(F.col("_hit")), "left_semi"))

    filter = where

    def not_(self, sub: Callable[[T], T]) -> T:
        return self._next(self.frame.join(self._reached(sub), F.col("cur").eqNullSafe(F.col("_hit")), "left_anti"))

    def and_(self, *subs: Callable[[T], T]) -> T:
        return reduce(lambda t, s: t.where(s), subs, self)

    def or_(self, *subs: Callable[[T], T]) -> T:
        hits = reduce(DataFrame.unionByName, [self._reached(s) for s in subs]).distinct()
        return self._next(self.frame.join(hits, F.col("cur").eqNullSafe(F.col("_hit")), "left_semi"))

    def where_labels(self, a: str, b: str, same: bool = True) -> T:
        test = F.col(f"as_{a}").eqNullSafe(F.col(f"as_{b}"))
        return self._next(self.frame.where(test if same else ~test))

    def coin(self, p: float, seed: int = 0) -> T:
        """Each traverser stays with chance ``p``, by a hash of its place, history and number: repeatable under any partitioning."""
        bits = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in ("cur", *self.carry)]), F.lit(1 << 40))
        stay = lambda i: F.pmod(F.xxhash64(bits, i), F.lit(1 << 40)) < F.lit(int(p * (1 << 40)))
        left = F.size(F.filter(F.sequence(F.lit(1).cast("long"), F.col("bulk")), stay)).cast("long")
        return self._next(self.frame.withColumn("bulk", left).where("bulk > 0"))

    def dedup(self, *labels: str) -> T:
        """One traverser for each place, or for each combination of labelled places."""
        keys = [f"as_{n}" for n in labels] or ["cur"]
        keep = [c for c in self.carry if c == "_start" and c not in keys]
        others = [c for c in ("cur", *self.carry) if c not in keys and c not in keep]
        one = F.min(F.struct(*[F.col(c) for c in others])).alias("_o") if others else F.lit(None).alias("_o")
        df = self.frame.groupBy(*keys, *keep).agg(one)
        return self._next(df.select(*keys, *keep, *[F.col(f"_o.{c}").alias(c) for c in others], F.lit(1).cast("long").alias("bulk")))

    def simple_path(self) -> T:
        return self._next(self.frame.where(F.size(F.array_distinct("path")) == F.size("path")))

    def cyclic_path(self) -> T:
        return self._next(self.frame.where(F.size(F.array_distinct("path")) < F.size("path")))

    # Hops -------------------------------------------------------------------
    def _hop(self, labels: tuple[str, ...], from_: str, to: str, element: str) -> T:
        e = self.graph.edges.where(F.col("label").isin(list(labels))) if labels else self.graph.edges
        e = e.select(F.col(from_).alias("_from"), (F.col(to) if element == "vertex" else _edge_key()).alias("_to"))
        df = self._merged().join(e, F.col("cur") == F.col("_from"))
        df = df.withColumn("cur", F.col("_to")).drop("_from", "_to")
        return self._step(df, element)

    def _step(self, df: DataFrame, kind: str) -> T:
        if "path" in self.carry:
            df = df.withColumn("path", F.concat("path", F.array(F.col("cur").cast("string"))))
        return self._next(df, kind)

    def out(self, *labels: str) -> T:
        return self._hop(labels, "src", "dst", "vertex")

    def in_(self, *labels: str) -> T:
        return self._hop(labels, "dst", "src", "vertex")

    def both(self, *labels: str) -> T:
        return self._next(self.out(*labels).frame.unionByName(self.in_(*labels).frame), "vertex")

    def out_e(self, *labels: str) -> T:
        return self._hop(labels, "src", "dst", "edge")

    def in_e(self, *labels: str) -> T:
        return self._hop(labels, "dst", "src", "edge")

    def both_e(self, *labels: str) -> T:
        return self._next(self.out_e(*labels).frame.unionByName(self.in_e(*labels).frame), "edge")

    def _end(self, column: str) -> T:
        # An edge's key holds both ends, so no second join is needed.
        part = {"src": 1, "dst": 2}[column]
        return self._step(self.frame.withColumn("cur", F.split("cur", "\u0001")[part]), "vertex")

    def out_v(self) -> T:
        return self._end("src")

    def in_v(self) -> T:
        return self._end("dst")

    def both_v(self) -> T:
        return self._next(self._end("src").frame.unionByName(self._end("dst").frame), "vertex")

    def other_v(self, label: str) -> T:
        """The end of the edge that is not the vertex labelled with ``as_(label)`` before it; both ends of a loop are that vertex."""
        parts = F.split("cur", "\u0001")
        return self._step(self.frame.withColumn("cur", F.when(parts[1] == F.col(f"as_{label}"), parts[2]).otherwise(parts[1])), "vertex")

    def to_e(self, direction: str, *labels: str) -> T:
        """``out``, ``in`` or ``both`` edges."""
        return {"out": self.out_e, "in": self.in_e, "both": self.both_e}[direction](*labels)

    def to_v(self, direction: str, *labels: str) -> T:
        """``out``, ``in`` or ``both`` neighbours; on edges their ends."""
        if self.kind == "edge":
            return {"out": self.out_v, "in": self.in_v, "both": self.both_v}[direction]()
        return {"out": self.out, "in": self.in_, "both": self.both}[direction](*labels)

    # Maps ---------------------------------------------------------------------
    def map(self, f: Callable[[Column], Column]) -> T:
        return self._next(self.frame.withColumn("cur", f(F.col("cur"))), "value")

    def flat_map(self, f: Callable[[Column], Column]) -> T:
        return self._next(self.frame.withColumn("cur", F.explode(f(F.col("cur")))), "value")

    def identity(self) -> T:
        return self

    def constant(self, x) -> T:
        return self.map(lambda c: F.lit(x))

    def values(self, *keys: str) -> T:
        looked = self._look({"_p": F.array(*[self._property(k).cast("string") for k in keys])}) if len(keys) > 1 else self._look({"_p": self._property(keys[0])})
        value = F.explode(F.filter("_p", lambda x: x.isNotNull())) if len(keys) > 1 else F.col("_p")
        return self._next(looked.withColumn("cur", value).drop("_p").where("cur IS NOT NULL"), "value")

    def id_(self) -> T:
        return self._next(self.frame, "value")

    def label(self) -> T:
        return self.values("label")

    def value_map(self, *keys: str) -> T:
        looked = self._look({"_p": F.create_map(*[x for k in keys for x in (F.lit(k), self._property(k).cast("string"))])})
        return self._next(looked.withColumn("cur", F.map_filter("_p", lambda k, v: v.isNotNull())).drop("_p"), "value")

    def properties(self, *keys: str) -> T:
        """One value for each set property: struct(element, key, value); without keys, all those of an edge or the text ones of a vertex."""
        if self.kind == "edge" and not keys:
            looked = self._look({"_p": F.transform(F.map_entries(F.coalesce("props", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))})
        else:
            names = keys or tuple(f.name for f in self.graph.vertices.schema if f.dataType.simpleString() == "string" and f.name not in ("vid", "label"))
            looked = self._look({"_p": F.filter(F.array(*[F.struct(F.lit(k).alias("key"), self._property(k).cast("string").alias("value")) for k in names]), lambda x: x["value"].isNotNull())})
        df = looked.withColumn("_e", F.col("cur")).withColumn("_x", F.explode("_p")).withColumn("cur", F.struct(F.col("_e").cast("string").alias("element"), F.col("_x.key").alias("key"), F.col("_x.value").alias("value")))
        return T(self.graph, df.drop("_e", "_x", "_p"), "property:" + self.kind, self.carry, self.starts)

    def property_map(self, *keys: str) -> T:
        """Like ``value_map``, each value as struct(element, key, value)."""
        return self.value_map(*keys)._keyed()

    def _keyed(self) -> T:
        return self.map(lambda c: F.transform_values(c, lambda k, v: F.struct(k.alias("key"), v.alias("value"))))

    def element(self) -> T:
        """From properties back to what has them."""
        return self._next(self.frame.withColumn("cur", F.col("cur.element")), self.kind.removeprefix("property:"))

    def key(self) -> T:
        return self._next(self.frame.withColumn("cur", F.col("cur.key")), "value")

    def value(self) -> T:
        return self._next(self.frame.withColumn("cur", F.col("cur.value")), "value")

    def has_key(self, *keys: str) -> T:
        return self._next(self.frame.where(F.col("cur.key").isin(list(keys))))

    def has_value(self, *values) -> T:
        return self._next(self.frame.where(F.col("cur.value").isin(list(values))))

    def element_map(self, *keys: str) -> T:
        return self.value_map("id" if self.kind == "vertex" else "src", "label", *keys)

    def math(self, f: Callable[[Column], Column]) -> T:
        return self.map(lambda c: f(c.cast("double")))

    def index(self) -> T:
        return self.map(lambda c: F.transform(c, lambda x, i: F.struct(x.alias("value"), i.alias("index"))))

    # List and text algebra on the current value.
    def combine(self, xs) -> T:
        return self.map(lambda c: F.concat(c, F.lit(xs)))

    def conjoin(self, sep: str) -> T:
        return self.map(lambda c: F.array_join(c, sep))

    def difference(self, xs) -> T:
        return self.map(lambda c: F.array_except(c, F.lit(xs)))

    def disjunct(self, xs) -> T:
        return self.map(lambda c: F.array_union(F.array_except(c, F.lit(xs)), F.array_except(F.lit(xs), c)))

    def intersect(self, xs) -> T:
        return self.map(lambda c: F.array_intersect(c, F.lit(xs)))

    def merge(self, xs) -> T:
        return self.map(lambda c: F.array_union(c, F.lit(xs)))

    def product(self, xs) -> T:
        return self.map(lambda c: F.flatten(F.transform(c, lambda x: F.transform(F.lit(xs), lambda y: F.array(x, y)))))

    def reverse(self) -> T:
        return self.map(F.reverse)

    def all_(self, p: P) -> T:
        return self._next(self.frame.where(F.forall("cur", p.test)))

    def any_(self, p: P) -> T:
        return self._next(self.frame.where(F.exists("cur", p.test)))

    def none_(self, p: P) -> T:
        return self._next(self.frame.where(~F.exists("cur", p.test)))

    def concat(self, x: str) -> T:
        return self.map(lambda c: F.concat(c, F.lit(x)))

    def format(self, template: str) -> T:
        return self.map(lambda c: F.format_string(template, c))

    def split(self, sep: str) -> T:
        import re

        return self.map(lambda c: F.split(c, re.escape(sep)))

    def substring(self, start: int, end: int | None = None) -> T:
        return self.map(lambda c: F.substr(c, F.lit(start + 1), F.lit((1 << 30) if end is None else end - start)))

    def replace(self, a: str, b: str) -> T:
        return self.map(lambda c: F.replace(c, F.lit(a), F.lit(b)))

    def trim(self) -> T:
        return self.map(F.trim)

    def l_trim(self) -> T:
        return self.map(F.ltrim)

    def r_trim(self) -> T:
        return self.map(F.rtrim)

    def to_lower(self) -> T:
        return self.map(F.lower)

    def to_upper(self) -> T:
        return self.map(F.upper)

    def length(self) -> T:
        return self.map(F.length)

    def as_string(self) -> T:
        return self.map(lambda c: c.cast("string"))

    def as_number(self) -> T:
        return self.map(lambda c: c.try_cast("double"))

    def as_bool(self) -> T:
        return self.map(lambda c: c.try_cast("boolean"))

    def as_date(self) -> T:
        return self.map(F.try_to_timestamp)

    def date_add(self, unit: str, n: int) -> T:
        return self.map(lambda c: F.timestamp_add(unit, F.lit(n), c))

    def date_diff(self, other) -> T:
        return self.map(lambda c: F.unix_seconds(c) - F.unix_seconds(F.lit(other).cast("timestamp")))

    # Reducers -------------------------------------------------------------------
    def _groups(self) -> list[str]:
        return [c for c in self.carry if c == "_start"]

    def _reduce(self, value: Column) -> T:
        keep = self._groups()
        df = self.frame.groupBy(*keep).agg(value.alias("cur"))
        return self._next(df.withColumn("bulk", F.lit(1).cast("long")), "value", tuple(keep))

    def _for_all_starts(self, t: T, nothing: Column) -> T:
        """A reducer's result also for places from which nothing was reached."""
        if self.starts is None or not self._groups():
            return t
        full = self.starts.withColumnRenamed("_start", "_s").join(t.frame, F.col("_s").eqNullSafe(F.col("_start")), "left")
        return t._next(full.select(F.col("_s").alias("_start"), F.coalesce("cur", nothing).alias("cur"), F.lit(1).cast("long").alias("bulk")))

    def count(self) -> T:
        """Inside a filter or local step, places without a result count zero, so ``count().is_(0)`` finds them."""
        return self._for_all_starts(self._reduce(F.coalesce(F.sum("bulk"), F.lit(0))), F.lit(0))

    def count_local(self) -> T:
        return self.map(F.size)

    def sum(self) -> T:
        return self._reduce(F.sum(F.col("cur") * F.col("bulk")))

    def min(self) -> T:
        return self._reduce(F.min("cur"))

    def max(self) -> T:
        return self._reduce(F.max("cur"))

    def mean(self) -> T:
        return self._reduce(F.sum(F.col("cur") * F.col("bulk")) / F.sum("bulk"))

    def sum_local(self) -> T:
        return self.map(lambda c: F.aggregate(c, F.lit(0).cast("double"), lambda a, x: a + x))

    def min_local(self) -> T:
        return self.map(F.array_min)

    def max_local(self) -> T:
        return self.map(F.array_max)

    def mean_local(self) -> T:
        return self.map(lambda c: F.try_divide(F.aggregate(c, F.lit(0).cast("double"), lambda a, x: a + x), F.size(c)))

    def order_local(self, desc: bool = False) -> T:
        return self.map(lambda c: F.sort_array(c, not desc))

    def limit_local(self, n: int) -> T:
        return self.map(lambda c: F.slice(c, 1, n))

    def range_local(self, a: int, b: int) -> T:
        return self.map(lambda c: F.slice(c, a + 1, b - a))

    def tail_local(self, n: int) -> T:
        return self.map(lambda c: F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), F.lit(n)))

    def dedup_local(self) -> T:
        return self.map(F.array_distinct)

    def fold(self) -> T:
        """The values as one sorted list, each as often as it was reached. A list is one value: fold what is small, count what is not."""
        t = self._reduce(F.sort_array(F.flatten(F.collect_list(F.array_repeat("cur", F.expr("IF(bulk > 2147483647, raise_error('fold: more values than a list holds'), CAST(bulk AS INT))"))))))
        return self._for_all_starts(t, F.array().cast(t.frame.schema["cur"].dataType))

    def unfold(self) -> T:
        return self._next(self.frame.withColumn("cur", F.explode("cur")), "value")

    def group_count(self, key: str | None = None) -> DataFrame:
        """(key, n) of the current values, or of a property."""
        df = self.frame.withColumn("_p", F.col("cur")) if key is None else self._look({"_p": self._property(key)})
        return df.groupBy(F.col("_p").alias("key")).agg(F.sum("bulk").alias("n"))

    def group(self, key: str, value: Column | None = None) -> DataFrame:
        """(key, members): sorted places by a property, or an aggregate of them."""
        df = self._look({"_p": self._property(key)})
        return df.groupBy(F.col("_p").alias("key")).agg((F.sort_array(F.collect_list("cur")) if value is None else value).alias("members"))

    # Order and slices --------------------------------------------------------------
    def order(self, key: str | None = None, desc: bool = False) -> T:
        return self.order_by((key, desc))

    def order_by(self, *keys: tuple[str | None, bool]) -> T:
        """By several (property or None for the value, descending); ties by place. The order outlasts later steps up to a reducer."""
        df = self._look({f"_o{i}": self._property(k) for i, (k, _) in enumerate(keys) if k is not None}) if any(k is not None for k, _ in keys) else self.frame
        by = [(F.col("cur") if k is None else F.col(f"_o{i}"), desc) for i, (k, desc) in enumerate(keys)]
        return self._ranked(df, [*by, (F.col("cur").cast("string"), False)])

    def shuffle(self, seed: int = 0) -> T:
        place = F.col("cur").cast("string")
        return self._ranked(self.frame, [(F.xxhash64(F.lit(seed), place), False), (place, False)])

    def _ranked(self, df: DataFrame, by: list[tuple[Column, bool]]) -> T:
        names = [f"_sort{i}_{'desc' if desc else 'asc'}" for i, (_, desc) in enumerate(by)]
        kept = [c for c in self.carry if not c.startswith("_sort")]
        fresh = df.select("cur", "bulk", *kept, *[c.alias(n) for n, (c, _) in zip(names, by, strict=True)])
        return self._next(fresh, carry=(*kept, *names))

    def _sorted(self) -> DataFrame:
        by = [F.col(c).desc_nulls_last() if c.endswith("desc") else F.col(c).asc_nulls_last() for c in self.carry if c.startswith("_sort")]
        return self.frame.orderBy(*by) if by else self.frame

    def _first(self, n: int) -> DataFrame:
        """The first rows that hold ``n`` traversers, with ``_run``, the traversers up to and with each; there are at most n rows."""
        rows = self._sorted().limit(min(n, (1 << 31) - 1)).withColumn("_n", F.monotonically_increasing_id())
        return rows.withColumn("_run", F.sum("bulk").over(W.partitionBy(F.lit(1)).orderBy("_n")))

    def range_(self, a: int, b: int) -> T:
        """Traversers a to b, exclusive; rows are cut where their bulk crosses a bound and none is spread out."""
        part = F.least(F.col("_run"), F.lit(b)) - F.greatest(F.col("_run") - F.col("bulk"), F.lit(a))
        df = self._first(b).withColumn("bulk", part).where("bulk > 0")
        return self._next(df.drop("_n", "_run"))

    def limit(self, n: int) -> T:
        return self.range_(0, n)

    def skip(self, n: int) -> T:
        """All but the first ``n`` traversers: the row that the bound cuts is found first, the rows before it are an offset.

        The frame is read more than once, so one without an order is put in the order of places first.
        """
        if n <= 0:
            return self
        if not any(c.startswith("_sort") for c in self.carry):
            return self._ranked(self._merged(), [(F.col("cur").cast("string"), False), *[(F.col(c).cast("string"), False) for c in self.carry]]).skip(n)
        cut = self._first(n).where(F.col("_run") <= n).agg(F.count("*").alias("rows"), F.coalesce(F.max("_run"), F.lit(0)).alias("held")).first()
        rest = self._sorted().offset(cut["rows"])
        if cut["held"] == n or cut["rows"] == 0 and rest.isEmpty():
            return self._next(rest)
        left = rest.limit(1).withColumn("bulk", F.col("bulk") - (n - cut["held"])).where("bulk > 0")
        return self._next(left.unionByName(rest.offset(1)))

    def tail(self, n: int, key: str | None = None) -> T:
        return self.order(key, desc=True).limit(n).order(key)

    def sample(self, n: int, seed: int = 0, by: str | None = None) -> T:
        """``n`` traversers without replacement, or all; ``by`` a numeric property that weighs places.

        A place enters by its least exponential draw, scaled by bulk and weight,
        and, once taken, by the next ones, at most n of them.
        """
        df = self.frame.withColumn("_w", F.lit(1.0)) if by is None else self._look({"_w": F.greatest(F.coalesce(self._property(by).cast("double"), F.lit(0.0)), F.lit(0.0))})
        unit = lambda i: -F.log((F.pmod(F.xxhash64(F.lit(seed), F.col("cur").cast("string"), i), F.lit(1 << 40)) + 1) / float(1 << 40))
        turns = F.sequence(F.lit(1).cast("long"), F.least(F.col("bulk"), F.lit(n).cast("long")))
        keys = F.transform(turns, lambda i: F.aggregate(F.sequence(F.lit(1).cast("long"), i), F.lit(0.0), lambda acc, j: acc + unit(j) / (F.col("bulk") - j + 1)) / F.col("_w"))
        drawn = df.where("_w > 0").withColumn("_k", F.explode(keys)).orderBy("_k", F.col("cur").cast("string")).limit(n).drop("_k", "_w").withColumn("bulk", F.lit(1).cast("long"))
        return self._next(drawn)

    # Labels, paths, sacks -------------------------------------------------------------
    def as_(self, name: str) -> T:
        return self._next(self.frame.withColumn(f"as_{name}", F.col("cur")), carry=(*[c for c in self.carry if c != f"as_{name}"], f"as_{name}"))

    def select(self, *names: str) -> T:
        if len(names) == 1:
            return self._next(self.frame.withColumn("cur", F.col(f"as_{names[0]}")), "vertex")
        return self._next(self.frame.withColumn("cur", F.struct(*[F.col(f"as_{n}").alias(n) for n in names])), "value")

    def project(self, **columns: str) -> T:
        looked = self._look({f"_{n}": self._property(k) for n, k in columns.items()})
        return self._next(looked.withColumn("cur", F.struct(*[F.col(f"_{n}").alias(n) for n in columns])).drop(*[f"_{n}" for n in columns]), "value")

    def with_path(self) -> T:
        """Carry the places passed from here on; rows then no longer merge by place."""
        return self._next(self.frame.withColumn("path", F.array(F.col("cur").cast("string"))), carry=(*self.carry, "path"))

    def path(self) -> T:
        return self._next(self.frame.withColumn("cur", F.col("path")), "value")

    def sack(self, start=None, step: Callable[[Column, Column], Column] | None = None) -> T:
        """With ``start`` begin a sack; with ``step`` fold the current value into it; else stand on it."""
        if start is not None:
            return self._next(self.frame.withColumn("sack", F.lit(start)), carry=(*self.carry, "sack"))
        if step is not None:
            return self._next(self.frame.withColumn("sack", step(F.col("sack"), F.col("cur"))))
        return self._next(self.frame.withColumn("cur", F.col("sack")), "value")

    # Branches ---------------------------------------------------------------------------
    def union(self, *subs: Callable[[T], T]) -> T:
        parts = [s(self) for s in subs]
        return self._next(reduce(DataFrame.unionByName, [p.frame for p in parts]), parts[0].kind, parts[0].carry)

    def choose(self, test: Callable[[T], T], then: Callable[[T], T], otherwise: Callable[[T], T] | None = None) -> T:
        return self.where(test).union(then)._joined(self.not_(test).union(otherwise or (lambda t: t)))

    def _joined(self, other: T) -> T:
        return self._next(self.frame.unionByName(other.frame))

    def choose_option(self, key: str, options: dict, otherwise: Callable[[T], T] | None = None) -> T:
        """A walk for each value of a property; others, and those without it, take ``otherwise`` or stay."""
        out = None
        for value, sub in options.items():
            part = sub(self.has(key, value))
            out = part if out is None else out._joined(part)
        rest = self._next(self._look({"_p": self._property(key)}).where(~F.coalesce(F.col("_p").isin(list(options)), F.lit(False))).drop("_p"))
        return out._joined(otherwise(rest) if otherwise else rest)

    def branch(self, *subs: Callable[[T], T]) -> T:
        """All walks from every traverser; with tests inside the walks this is a switch."""
        return self.union(*subs)

    def local(self, sub: Callable[[T], T]) -> T:
        """A walk whose reducers and slices work for each place by itself; every traverser of a place gets its results."""
        starts = self.frame.select("cur").distinct()
        probe = T(self.graph, starts.withColumns({"bulk": F.lit(1).cast("long"), "_start": F.col("cur")}), self.kind, ("_start",), starts.select(F.col("cur").alias("_start")))
        found = sub(probe)
        here = self.frame.select(F.col("cur").alias("_at"), F.col("bulk").alias("_b"), *self.carry)
        df = found.frame.select("cur", "bulk", F.col("_start").alias("_from")).join(here, F.col("_from").eqNullSafe(F.col("_at")))
        return T(self.graph, df.select("cur", (F.col("bulk") * F.col("_b")).alias("bulk"), *self.carry), found.kind, self.carry, self.starts)

    def fail(self, message: str) -> T:
        """An error as soon as a traverser gets here."""
        return self._next(self.frame.where(F.raise_error(F.lit(message)).cast("boolean")))

    def discard(self) -> T:
        return self._next(self.frame.where(F.lit(False)))

    def aggregate(self, collect: dict[str, DataFrame], name: str) -> T:
        """Keep the values so far under a name in ``collect``; the walk goes on. ``cap`` reads them."""
        held = self.frame.select(F.col("cur").alias("value"), "bulk")
        collect[name] = held if name not in collect else collect[name].unionByName(held)
        return self

    def cap(self, collect: dict[str, DataFrame], name: str) -> DataFrame:
        """(value, bulk) that ``aggregate`` kept, equal values together."""
        return collect[name].groupBy("value").agg(F.sum("bulk").alias("bulk"))

    def subgraph(self) -> Graph:
        """The edges of an edge walk and the vertices at their ends, as a graph."""
        e = self.graph.edges.join(self.frame.select("cur").distinct(), _edge_key() == F.col("cur"), "left_semi")
        ends = e.select(F.col("src").alias("vid")).unionByName(e.select(F.col("dst").alias("vid"))).distinct()
        return Graph(self.graph.vertices.join(ends, "vid", "left_semi"), e)

    def tree(self) -> DataFrame:
        """(depth, parent, node, n) of all paths so far: a tree level by level, equal beginnings merged. Needs ``with_path``."""
        at = F.posexplode(F.transform(F.col("path"), lambda x, i: F.struct(F.slice(F.col("path"), F.lit(1), i).alias("parent"), x.alias("node"))))
        rows = self.frame.select("bulk", at.alias("depth", "x")).select("bulk", "depth", "x.parent", "x.node")
        return rows.groupBy("depth", "parent", "node").agg(F.sum("bulk").alias("n"))

    def optional(self, sub: Callable[[T], T]) -> T:
        return sub(self)._joined(self.not_(sub))

    def coalesce(self, *subs: Callable[[T], T]) -> T:
        rest, out = self, None
        for s in subs:
            part = s(rest)
            out = part if out is None else out._joined(part)
            rest = rest.not_(s)
        return out

    def match(self, *patterns: tuple[str, Callable[[T], T], str]) -> T:
        """Patterns (a, walk, b) over labels; the current place must carry the first label."""
        t = self
        for a, walk, b in patterns:
            held = f"as_{b}" in t.carry
            t = walk(t.select(a))
            t = t._next(t.frame.where(F.col("cur") == F.col(f"as_{b}"))) if held else t.as_(b)
        return t

    def repeat(self, sub: Callable[[T], T], *, times: int | None = None, until: Callable[[T], T] | None = None, emit: bool = False, count_loops: bool = False, max_loops: int | None = None) -> T:
        """Walk ``sub`` again and again; ``until`` takes out rows that meet it, ``emit`` keeps every stage.

        Without ``times`` the walk ends when no row is left, however many rounds
        that takes; on a cycle it needs ``until``, ``simple_path`` or ``times``.
        ``max_loops`` is a guard: rows that are still walking after so many rounds
        are an error and never a shorter result. ``count_loops`` carries the round
        as ``loops``. Each round's rows are written and read back, so plans stay
        one round long. A walk of many rows or rounds whose ``sub`` is one hop goes
        on over a table of its steps, see ``_stride``. For closures of unknown depth
        use the semi-naive one.
        """
        rest, out, rounds = self, None, 0
        if count_loops:
            rest = rest._next(rest.frame.withColumn("loops", F.lit(0)), carry=(*[c for c in rest.carry if c != "loops"], "loops"))
        hop = _only_hop(sub) if until is not None and times is None and self.kind == "vertex" and set(rest.carry) <= {"loops"} and _by_place(until) else None
        if hop:
            rest = rest._next(settle(rest._merged()))
        while times is None or rounds < times:
            if hop and (rounds >= WALK or rest.frame.count() > MANY):
                return rest._stride(hop, sub, until, out, rounds, max_loops)
            rest = sub(rest)
            if count_loops:
                rest = rest._next(rest.frame.withColumn("loops", F.col("loops") + 1))
            rest = rest._next(settle(rest._merged()))
            rounds += 1
            if until is not None:
                # Met once and written: the next round, the test for an end and the result read it.
                met = settle(rest._met(until))
                done, rest = (rest._next(met.where(side).drop("_met")) for side in ("_met", "NOT _met"))
                out = done if out is None else out._joined(done)
            elif emit:
                out = rest if out is None else out._joined(rest)
            if out is not None and rounds % 16 == 0:
                out = out._next(settle(out.frame))
            if times is None:
                if rest.frame.isEmpty():
                    break
                if max_loops is not None and rounds >= max_loops:
                    raise RuntimeError(f"repeat: rows are still walking after {max_loops} rounds")
        return rest if out is None else out

    def _met(self, until: Callable[[T], T]) -> DataFrame:
        """The frame with ``_met``: whether the place meets a test."""
        hits = self._reached(until).withColumn("_met", F.lit(True))
        return self.frame.join(hits, F.col("cur").eqNullSafe(F.col("_hit")), "left").drop("_hit").withColumn("_met", F.coalesce("_met", F.lit(False)))

    def _stride(self, hop: str, sub: Callable[[T], T], until: Callable[[T], T], out: T | None, rounds: int, max_loops: int | None) -> T:
        """The rest of a ``repeat`` whose walk and test depend on the place alone.

        Every place's steps, and whether they end the walk, are found once and lie in
        buckets of the place they begin from, so a round moves the walking rows and no
        edges. Where no place has two steps, each ``WALK_ON`` rounds double what a step
        spans: chains of n places take rounds by the logarithm of n.
        """
        e, rest, tables = self.graph.edges, self.frame, []
        if _names(sub)[0][0] == hop:
            probe = _Ends(self.graph, None, "vertex", ("_start",))
        else:
            ends = [e.select(F.col(c).alias("cur")) for c in {"out": ("src",), "in_": ("dst",), "both": ("src", "dst")}[hop]]
            starts = reduce(DataFrame.unionByName, ends).distinct()
            probe = T(self.graph, starts.withColumns({"bulk": F.lit(1).cast("long"), "_start": F.col("cur")}), "vertex", ("_start",), starts.select(F.col("cur").alias("_start")))
        pairs = probe._next(settle(sub(probe)._merged()))
        buckets = min(1 + pairs.frame.count() // ROWS_A_BUCKET, 10_000)

        def keep(df: DataFrame) -> DataFrame:
            name, table = settle_by(df, "_from", buckets)
            tables.append(name)
            return table

        try:
            steps = keep(pairs._met(until).select(F.col("_start").alias("_from"), F.col("cur").alias("_to"), F.col("bulk").alias("_n"), F.lit(1).alias("_far"), "_met"))
            double, walked, single = max_loops is None, 0, False
            left = rest.count()
            while left:
                if double and walked == WALK_ON:
                    single = single or steps.groupBy("_from").agg(F.sum("_n").alias("n")).where("n > 1").isEmpty()
                    double, walked = single, 0
                    if single:
                        on = steps.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"), F.col("_far").alias("_more"), F.col("_met").alias("_ends"))
                        longer = steps.where("NOT _met").drop("_met").join(on, "_to").select("_from", F.col("_next").alias("_to"), "_n", (F.col("_far") + F.col("_more")).alias("_far"), F.col("_ends").alias("_met"))
                        steps = keep(steps.where("_met").unionByName(longer))
                # Walking rows are merged, so a place has few of them and they fit as the hashed side.
                moved = (F.broadcast(rest) if left <= MANY else rest.hint("shuffle_hash")).join(steps, F.col("cur") == F.col("_from"))
                carried = [(F.col(c) + F.col("_far")).alias(c) for c in self.carry]
                moved = settle(moved.select(F.col("_to").alias("cur"), (F.col("bulk") * F.col("_n")).alias("bulk"), *carried, "_met").groupBy("cur", *self.carry, "_met").agg(F.sum("bulk").alias("bulk")))
                rounds, walked = rounds + 1, walked + 1
                done, rest = (moved.where(side).drop("_met") for side in ("_met", "NOT _met"))
                out = self._next(done) if out is None else out._joined(self._next(done))
                if rounds % 16 == 0:
                    out = out._next(settle(out.frame))
                left = rest.count()
                if left and max_loops is not None and rounds >= max_loops:
                    raise RuntimeError(f"repeat: rows are still walking after {max_loops} rounds")
        finally:
            for name in tables:
                e.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        return self._next(rest) if out is None else out

    def loops(self) -> T:
        """The round in which a row left ``repeat(count_loops=True)``."""
        return self._next(self.frame.withColumn("cur", F.col("loops")), "value")

    # Results -----------------------------------------------------------------------------
    @property
    def df(self) -> DataFrame:
        """(value, bulk) and carried columns."""
        return self._sorted().withColumnRenamed("cur", "value").drop(*[c for c in self.carry if c.startswith("_sort")])

    def to_list(self, limit: int | None = None) -> list:
        """Values on the driver, each as often as it was reached; with ``limit`` only so many. The ad-hoc surface asks for ``MAX_ROWS``."""
        few = self if limit is None else self.limit(limit)
        return [r[0] for r in few._sorted().select("cur", "bulk").collect() for _ in range(r[1])]

    def explain(self) -> None:
        self.frame.explain("formatted")


class _Ends(T):
    """Stands on every place that has edges; where a walk's first step is its hop, the edges are that step."""

    def _hop(self, labels: tuple[str, ...], from_: str, to: str, element: str) -> T:
        e = self.graph.edges.where(F.col("label").isin(list(labels))) if labels else self.graph.edges
        return self._next(e.where(F.col(from_).isNotNull()).select(F.col(to).alias("cur"), F.lit(1).cast("long").alias("bulk"), F.col(from_).alias("_start")), element)


class _Names(T):
    """Writes down the names of steps instead of taking them; ``inner`` has those of walks inside steps."""

    def __init__(self):
        self.names, self.inner = [], []

    def __getattribute__(self, name: str):
        if name in ("names", "inner") or name.startswith("__"):
            return object.__getattribute__(self, name)
        self.names.append(name)

        def step(*args, **more):
            for walk in (*args, *more.values()):
                if callable(walk):
                    names, inner = _names(walk)
                    self.inner.extend((*names, *inner))
            return self

        return step


def _names(walk: Callable[[T], T]) -> tuple[list[str], list[str]]:
    """Names of a walk's steps and of the walks inside them; "?" where it does more than take steps."""
    t = _Names()
    try:
        return (t.names, t.inner) if walk(t) is t else (["?"], [])
    except Exception:  # noqa: BLE001  # What the walk needs beyond steps is not known here; taken as it is, it says what is wrong.
        return ["?"], []


_HOPS = {"out", "in_", "both"}
_FILTERS = {"has", "has_label", "has_not", "has_id", "where", "filter", "not_", "and_", "or_", "identity"}
_TESTS = _HOPS | _FILTERS | {"out_e", "in_e", "both_e", "out_v", "in_v", "both_v", "values", "count", "is_"}


def _by_place(test: Callable[[T], T]) -> bool:
    """Whether a test has only steps that try each place by itself, whatever other rows there are."""
    names, inner = _names(test)
    return {*names, *inner} <= _TESTS


def _only_hop(walk: Callable[[T], T]) -> str | None:
    """The hop of a walk that has one, and filters by place around it."""
    names, inner = _names(walk)
    hops = [n for n in names if n in _HOPS]
    return hops[0] if len(hops) == 1 and set(names) <= _HOPS | _FILTERS and set(inner) <= _TESTS else None


# What a read-only query text must not contain, and how it begins.
DENIED = ("addv(", "adde(", "mergev(", "mergee(", "drop(", "property(", "sideeffect(", "io(", "call(", "program(")


def refuse_query(text: str) -> str | None:
    """Why a query text is not taken as a read-only traversal, or None."""
    flat = "".join(text.split()).lower().replace("_", "")
    if len(text) > MAX_QUERY:
        return f"Query exceeds {MAX_QUERY} characters"
    if not flat.startswith("g."):
        return "Query must be a traversal that starts with g."
    bad = [d for d in DENIED if f".{d}" in flat]
    return f"Rejected: mutating or side-effect step {bad[0].rstrip('(')}" if bad else None


def rendered(df: DataFrame, column: str = "value") -> DataFrame:
    """The first rows as text lines within the row, value and total limits."""
    line = F.substring(F.col(column).cast("string"), 1, MAX_VALUE)
    few = df.select(line.alias("line")).limit(MAX_ROWS).withColumn("_n", F.monotonically_increasing_id())
    w = W.partitionBy(F.lit(1)).orderBy("_n")
    return few.withColumn("_run", F.sum(F.length("line")).over(w)).where(F.col("_run") <= MAX_CHARS).select("line")
