"""Set, roster and text operators over the driver's tables, each called as it is."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import sets as ST
from ..sources import ledgers as L
from .ledger_queries import _DUCK_K, _k
from .registry import query


@query("""
WITH e AS (SELECT user_id || ' ' || CAST(ts AS DATE) AS k, event_type FROM events), a AS (SELECT DISTINCT k FROM e WHERE event_type = 'purchase'), b AS (SELECT DISTINCT k FROM e WHERE event_type = 'signup')
SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)
""")
def sets_symmetric(t):
    """Days of users with a purchase and no signup, and the reverse."""
    of = lambda kind: t.events.where(F.col("event_type") == kind).select(F.concat_ws(" ", "user_id", F.to_date("ts")).alias("k"))
    return ST.symmetric_difference(of("purchase"), of("signup"), key="k")


@query("""
WITH d AS (SELECT c_nationkey AS k, c_custkey AS o, list_sort(list(DISTINCT o_orderpriority)) AS items FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
  l AS (SELECT k, items, lag(items) OVER (PARTITION BY k ORDER BY o) AS prev FROM d)
SELECT k, bool_and(prev IS NULL OR items[1:len(prev)] = prev) AS consistent FROM l GROUP BY k
""")
def sets_chain(t):
    """Whether each customer of a nation has the priorities of the one before, and may be more."""
    rows = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"))
    lists = rows.groupBy(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("o")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("items"))
    return ST.consistent_chain(lists, key="k", order="o", items="items")


@query("""
SELECT conv_id, count(*) FILTER (role = 'user') > 0 AND (trim(coalesce(arg_min(text, turn), '')) <> '' OR count(*) FILTER (role = 'system') > 0) AS kept FROM conversations GROUP BY 1
""")
def sets_substance(t):
    g = t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"), F.min_by("text", "turn").alias("prompt"), F.count_if(F.col("role") == "system").alias("tools"))
    return g.select("conv_id", ST.has_substance(F.col("turns"), F.col("prompt"), F.col("tools")).alias("kept"))


@query(f"SELECT DISTINCT user_id FROM events WHERE {_DUCK_K} >= 97")
def sets_proven(t):
    return ST.proven_roots(t.events.select("user_id", (_k() >= 97).alias("proof")), root="user_id", proof="proof")


@query(f"""
WITH u AS (SELECT event_type, CASE WHEN event_type <> 'error' THEN {_DUCK_K} END AS a, CAST(user_id % 5 AS BIGINT) AS b, CASE WHEN {_DUCK_K} > 50 THEN CAST(round(value * 100) AS BIGINT) END AS c FROM events)
SELECT event_type, sum(coalesce(c, 0)) / nullif(sum(coalesce(a, 0) + b + coalesce(c, 0)), 0) AS ratio FROM u GROUP BY 1
""")
def sets_cache_ratio(t):
    kind, k = F.col("event_type"), _k()
    rows = t.events.select(kind, F.when(kind != "error", k).alias("input_tokens"), (F.col("user_id") % 5).alias("cache_creation_input_tokens"), F.when(k > 50, F.round(F.col("value") * 100).cast("long")).alias("cache_read_input_tokens"))
    return ST.cache_hit_ratio(rows, group="event_type")


@query(r"""
SELECT doc_id, concat_ws(' — ', nullif(trim(source), ''), nullif(trim(left(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), 180)), '')) AS line FROM documents
""")
def sets_summary_line(t):
    return t.documents.select("doc_id", ST.summary_line(F.col("source"), F.col("text")).alias("line"))


@query("""
WITH s AS (SELECT doc_id, text, left(array_to_string(string_split(text, chr(10))[1:4], chr(10)), 300) AS cut FROM documents)
SELECT doc_id, CASE WHEN cut = text THEN text ELSE cut || '…' END AS shown FROM s
""")
def sets_capped_text(t):
    return t.documents.select("doc_id", ST.capped_text(F.col("text"), lines=4, chars=300).alias("shown"))


@query("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.query'), ''), nullif(json_extract_string(props, '$.k'), ''), '') AS said FROM events")
def sets_call_summary(t):
    return t.events.select("event_id", ST.call_summary(F.col("props"), ("query", "k")).alias("said"))


@query("SELECT doc_id, left(sha256(text), 12) AS name FROM documents")
def sets_protocol_hash(t):
    return t.documents.select("doc_id", ST.protocol_hash(F.col("text")).alias("name"))


@query("""
SELECT event_id, epoch(TIMESTAMP '2024-02-01') - CAST(floor(epoch(ts)) AS BIGINT) AS age_s, event_type = 'view' AS between_turns, ts + INTERVAL 20 DAY <= TIMESTAMP '2024-02-01' AS expired FROM events
""")
def sets_descriptors(t):
    at = F.col("ts").cast("timestamp")
    rows = t.events.select("event_id", F.when(F.col("event_type") == "view", "idle").otherwise("busy").alias("status"), at.alias("at"), (at + F.expr("INTERVAL 20 DAY")).alias("until"))
    out = ST.descriptor_state(rows, F.lit("2024-02-01").cast("timestamp"), at="at", expires="until")
    return out.select("event_id", F.col("age_s").cast("double").alias("age_s"), "between_turns", "expired")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus = 'P' DESC, o_orderdate DESC, o_orderkey LIMIT 40")
def sets_active_first(t):
    rows = t.orders.withColumn("at", F.struct("o_orderdate", -F.col("o_orderkey")))
    return ST.active_first(rows, active=F.col("o_orderstatus") == "P", at="at", limit=40).select("o_orderkey", "o_orderstatus")


@query("""
SELECT coalesce(c_custkey, s_suppkey) AS key, coalesce(c_name, s_name) AS name, CASE WHEN c_custkey IS NULL THEN 'supplier' ELSE 'customer' END AS harness
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey
""")
def sets_roster(t):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("customer").alias("harness"))
    b = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("supplier").alias("harness"))
    return ST.merged_roster(a, b, key="key", columns=("name", "harness"))


@query("SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag IN ('N', 'R')")
def sets_import_policy(t):
    depth, kind = F.when(F.col("l_linestatus") == "O", "module").otherwise("function"), F.when(F.col("l_returnflag") == "N", "import").when(F.col("l_returnflag") == "R", "from").otherwise("lazy")
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), depth.alias("depth"), kind.alias("kind"))
    return ST.import_policy(edges).select("src", "dst").distinct()


@query("""
WITH m AS (SELECT n_name AS name, CASE WHEN n_nationkey = 3 THEN 'main' WHEN n_nationkey = 5 THEN '' ELSE r_name END AS scope, n_nationkey AS k FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT 'scope' AS rule, name AS subject FROM m WHERE scope IN ('main', '')
UNION ALL SELECT 'scope-twice', name FROM m WHERE scope IN (SELECT scope FROM m GROUP BY scope HAVING count(*) > 1)
UNION ALL SELECT 'allows-nothing', name FROM m WHERE k % 6 = 0 UNION ALL SELECT 'bare-kind', name FROM m WHERE k % 4 = 1
""")
def sets_manifests(t):
    """Expert manifests: in main or without a scope, one scope twice, nothing allowed, kinds without a prefix."""
    n = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    scope = F.when(F.col("n_nationkey") == 3, "main").when(F.col("n_nationkey") == 5, "").otherwise(F.col("r_name"))
    allow = F.when(F.col("n_nationkey") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("src/*")))
    kinds = F.when(F.col("n_nationkey") % 4 == 1, F.array(F.lit("x/a"), F.lit("bare"))).otherwise(F.array(F.lit("x/a")))
    return ST.check_manifests(n.select(F.col("n_name").alias("name"), scope.alias("scope"), allow.alias("allow"), kinds.alias("kinds")))


@query(r"""
SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MiB', b / 1048576) ELSE printf('%.1f GiB', b / 1073741824) END AS size,
  CASE WHEN regexp_matches(lower(text), '\b(should|design|architecture|approach|trade-?off|choose|decide|structure)\b') THEN 'design' ELSE 'general' END AS kind, '> ' || replace(text, chr(10), chr(10) || '> ') AS quoted
FROM (SELECT *, CAST(n_chars AS BIGINT) * n_chars AS b FROM documents)
""")
def text_rendering(t):
    """Readable sizes, the kind of a question and block quotes of whole texts."""
    return t.documents.select("doc_id", X.human_bytes(F.col("n_chars") * F.col("n_chars")).alias("size"), X.question_kind(F.col("text")).alias("kind"), X.quote_block(F.col("text")).alias("quoted"))


_CLASS = "CASE WHEN event_type = 'error' AND value < 5 THEN 'rejected' WHEN event_type = 'error' THEN 'miss' WHEN event_type = 'signup' AND value < 20 THEN 'legacy' ELSE 'hit' END"


@query(f"SELECT event_id, {_CLASS} AS class, CASE WHEN {_CLASS} = 'hit' THEN 2 ELSE 0 END AS ids, 'memory_recall: k' || {_DUCK_K} AS asked FROM events")
def tap_event_classes(t):
    """Raw tool calls parsed as the tap reads them: their class, the ids that they returned, what was asked."""
    hit = F.concat(F.lit("see `scope:main:claim:"), F.col("user_id"), F.lit("` and `scope:main:thread:t` and `scope:main:claim:"), F.col("user_id"), F.lit("`"))
    error = F.col("event_type") == "error"
    said = F.when(error & (F.col("value") < 5), "Rejected: mutating step").when(error, "No matching memories found.").when((F.col("event_type") == "signup") & (F.col("value") < 20), "an answer without ids").otherwise(hit)
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), said.alias("text"))))
    raw = t.events.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("user_id").cast("string").alias("session_id"), F.lit("mcp__memory__memory_recall").alias("tool_name"), F.to_json(F.struct(F.concat(F.lit("k"), _k()).alias("query"))).alias("tool_input"), blocks.alias("tool_response"), F.lit("p").alias("path"), F.col("event_id").alias("line_no"))
    e = L.tap_events(raw)
    kind = F.when(F.col("is_rejected"), "rejected").when(F.col("is_miss"), "miss").when(F.col("is_legacy"), "legacy").otherwise("hit")
    return e.select(F.col("line_no").alias("event_id"), kind.alias("class"), F.size("returned").alias("ids"), F.col("query_text").alias("asked"))
