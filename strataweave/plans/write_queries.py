"""Queries over upserts, draws, caps and change points."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats as S
from ..functions import text as X
from ..operators import graph as G
from ..operators import ranking as R
from ..sources import store as ST
from .ceremonies import draw
from .recall import withhold
from .registry import query


@query("""
SELECT coalesce(a.c_custkey, b.c_custkey) AS vid, coalesce(nullif(a.c_mktsegment, ''), b.seg) AS origin, greatest(a.c_nationkey, b.n) AS tier, coalesce(b.name, a.c_name) AS title
FROM (SELECT * FROM customer WHERE c_nationkey < 18) a FULL JOIN (SELECT c_custkey, 'new' AS seg, c_nationkey - 3 AS n, CASE WHEN c_custkey % 2 = 0 THEN 'renamed' END AS name FROM customer WHERE c_nationkey > 8) b ON a.c_custkey = b.c_custkey
""")
def upsert_merge(t):
    """A keyed merge: new values win, an origin keeps its first value, a tier never falls."""
    c = t.customer
    old = c.where("c_nationkey < 18").select(F.col("c_custkey").alias("vid"), F.col("c_mktsegment").alias("origin"), F.col("c_nationkey").alias("tier"), F.col("c_name").alias("title"))
    new = c.where("c_nationkey > 8").select(F.col("c_custkey").alias("vid"), F.lit("new").alias("origin"), (F.col("c_nationkey") - 3).alias("tier"), F.when(F.col("c_custkey") % 2 == 0, "renamed").alias("title"))
    return ST.upsert_vertices(old, new, hold_first=("origin",), never_lower=("tier",))


@query("""
WITH r AS (SELECT o_custkey AS src, l_suppkey AS dst, o_orderstatus, o_orderpriority FROM orders JOIN lineitem ON o_orderkey = l_orderkey), a AS (SELECT src, dst, max(o_orderpriority) AS p FROM r WHERE o_orderstatus = 'F' GROUP BY 1, 2), b AS (SELECT src, dst, max(o_orderstatus) AS s FROM r WHERE o_orderstatus <> 'F' GROUP BY 1, 2)
SELECT CAST(coalesce(a.src, b.src) AS VARCHAR) AS src, CAST(coalesce(a.dst, b.dst) AS VARCHAR) AS dst, a.p AS priority, b.s AS status FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst
""")
def edge_upsert(t):
    """Edges merge on their ends; properties of both sides stay, the newer win."""

    def side(rows, name, column):
        g = rows.groupBy(F.col("o_custkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst")).agg(F.max(column).alias("v"))
        nothing = F.lit(None).cast("string")
        return g.select(F.lit("ASKS").alias("label"), "src", "dst", nothing.alias("src_label"), nothing.alias("dst_label"), F.create_map(F.lit(name), F.col("v")).alias("props"))

    rows = t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey")
    merged = ST.upsert_edges(side(rows.where("o_orderstatus = 'F'"), "priority", "o_orderpriority"), side(rows.where("o_orderstatus <> 'F'"), "status", "o_orderstatus"))
    return merged.select("src", "dst", F.try_element_at("props", F.lit("priority")).alias("priority"), F.try_element_at("props", F.lit("status")).alias("status"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS unit, CASE WHEN n <= 30 THEN 'a' WHEN n <= 60 THEN 'b' END AS arm FROM (SELECT s_suppkey, row_number() OVER (ORDER BY sha256('seed' || chr(0) || CAST(s_suppkey AS VARCHAR)), CAST(s_suppkey AS VARCHAR)) AS n FROM supplier)")
def seeded_draw(t):
    return draw(t.supplier.select(F.col("s_suppkey").cast("string").alias("unit")), [("a", 30), ("b", 30)], "seed")


@query("""
WITH d AS (SELECT CAST(s_suppkey AS VARCHAR) AS node, CAST('0x' || substr(sha256('s1' || CAST(s_suppkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296 AS x FROM supplier WHERE s_nationkey = 3)
SELECT node, x < 0.5 AND x < (SELECT max(x) FROM d) AS withheld FROM d
""")
def seeded_withholding(t):
    """A repeatable coin for each node of one response; at least one always stays."""
    return withhold(t.supplier.where("s_nationkey = 3").select(F.col("s_suppkey").cast("string").alias("node")), rate=0.5, seed="s1")


@query("""
WITH f AS (SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 50), r AS (SELECT *, sum(n_chars) OVER (ORDER BY n_chars, doc_id) AS run FROM f)
SELECT doc_id, n_chars FROM r WHERE run <= 8000
""")
def render_cap(t):
    return R.running_cap(t.documents.select("doc_id", "n_chars"), order=[F.col("n_chars"), F.col("doc_id")], size=F.col("n_chars"), max_rows=50, max_size=8000)


@query("""
WITH n AS (SELECT 'before' AS scan, count(*) FILTER (o_orderstatus = 'O') AS a, count(*) FILTER (o_orderstatus = 'F') AS b FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' UNION ALL SELECT 'after', count(*) FILTER (o_orderstatus = 'O'), NULL FROM orders)
SELECT 'open' AS metric, (SELECT a FROM n WHERE scan = 'before') AS before, (SELECT a FROM n WHERE scan = 'after') AS after
UNION ALL SELECT 'final', (SELECT b FROM n WHERE scan = 'before'), NULL
""")
def scan_diff(t):
    """Metrics of two scans side by side; one that a scan lacks is null and not zero."""

    def metrics(rows, statuses):
        g = rows.groupBy("o_orderstatus").agg(F.count("*").alias("value"))
        name = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "final")
        return g.where(F.col("o_orderstatus").isin(statuses)).select(name.alias("metric"), "value")

    return G.metric_diff(metrics(t.orders.where(F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")), ["O", "F"]), metrics(t.orders, ["O"]))


@query("""
WITH p AS (SELECT c_nationkey, '#' || lpad(lower(to_hex(c_nationkey * 9)), 2, '0') || '8040' AS colour FROM customer GROUP BY 1), l AS (
  SELECT c_nationkey, colour, [('0x' || substr(colour, 2, 2))::INT / 255, ('0x' || substr(colour, 4, 2))::INT / 255, ('0x' || substr(colour, 6, 2))::INT / 255] AS v FROM p), m AS (
  SELECT c_nationkey, colour, list_transform(v, lambda x: CASE WHEN x <= 0.03928 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END) AS w FROM l)
SELECT c_nationkey, colour, round(1.05 / (0.2126 * w[1] + 0.7152 * w[2] + 0.0722 * w[3] + 0.05), 6) AS contrast FROM m
""")
def colour_contrast(t):
    n = t.customer.select("c_nationkey").distinct()
    colour = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("c_nationkey") * 9)), 2, "0"), F.lit("8040"))
    return n.withColumn("colour", colour).withColumn("contrast", F.round(S.contrast(F.lit("#ffffff"), F.col("colour")), 6))


@query("SELECT source, count(*) AS documents, count(*) FILTER (contains(lower(text), 'license')) AS licensed, max(lower(regexp_replace(regexp_replace(source, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'))) AS slug FROM documents GROUP BY 1")
def containment_counts(t):
    """Containment in any case by scope, with the scope's slug."""
    return t.documents.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(X.contains_any_case(F.col("text"), "LICENSE")).alias("licensed"), F.max(X.slug(F.col("source"))).alias("slug"))
