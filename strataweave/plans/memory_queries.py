"""Recall endpoints, stored recipes and contract checks over the memory graph of the driver's tables, called as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import contract as C
from ..operators import ranking as R
from ..operators.iterate import settle
from ..operators.traversal import T
from .memory_graph import MEMORY_SQL, memory_graph
from .recall import Recall
from . import writers as WR
from .recipes import RECIPES
from .registry import query

ASK = "the nature of pour les enre rthe erti"
WORDS = X.keywords(ASK)
_G = f"WITH {MEMORY_SQL} "
_BOTH = ["main", "lit"]


def _register(name: str, sql: str, build) -> None:
    def run(t):
        return build(memory_graph(t))

    run.__name__ = name
    query(_G + sql)(run)


def _times(*names: str):
    """Times as microseconds, which both engines print alike."""
    return lambda df: df.withColumns({n: F.unix_micros(n) for n in names})


# Stored recipes -------------------------------------------------------------------
_VALUES = "AS value, CAST(1 AS BIGINT) AS bulk"
_SESSION = "(SELECT min(vid) FROM ses)"

_RECIPES = {
    "graph_census": ("SELECT label AS key, count(*) AS n FROM v GROUP BY 1", lambda g, f: f(g)),
    "recent_sessions": (f"SELECT vid {_VALUES} FROM ses ORDER BY ts_us DESC LIMIT 3", lambda g, f: f(g, "main")),
    "claims_mentioning": ("SELECT count(*) AS value, CAST(1 AS BIGINT) AS bulk FROM (SELECT description FROM clm UNION ALL SELECT text FROM known) WHERE contains(lower(description), 'the')", lambda g, f: f(g, "THE")),
    "orphan_vertices": (f"SELECT vid {_VALUES} FROM v WHERE vid NOT IN (SELECT src FROM e UNION ALL SELECT dst FROM e)", lambda g, f: f(g)),
    "scope_census": ("SELECT 'main' AS scope, count(*) AS sessions, count(*) FILTER (ts_us < 1704067200000000 + 1800000000) AS before FROM ses", lambda g, f: f(g, "2024-01-01 00:30:00")),
    "answered_by": (f"SELECT vid {_VALUES} FROM exc WHERE expert = 'exp2' AND status = 'answered' ORDER BY ts_us DESC, vid LIMIT 10", lambda g, f: f(g, "exp2")),
    "taken_part": (f"SELECT vid {_VALUES} FROM exc WHERE expert = 'exp1' OR from_scope = 'exp1'", lambda g, f: f(g, "exp1")),
    "session_subgraph": ("SELECT label, count(*) AS n FROM e WHERE src = 'scope:main:session:1' GROUP BY 1", lambda g, f: f(g, "scope:main:session:1")),
    "witnessed_and_used": ("""
        , shown AS (SELECT DISTINCT c.dst AS x, r.dst AS node FROM e c JOIN e q ON c.src = q.src AND q.label = 'QUERIES' JOIN e r ON q.dst = r.src AND r.label = 'RETURNS' WHERE c.label = 'CONSULTS'),
        cited AS (SELECT DISTINCT src AS x, dst AS node FROM e WHERE label = 'REFERENCES')
        SELECT coalesce(s.x, c.x) AS exchange, count(s.x) AS shown, count(c.x) AS cited, count(*) FILTER (s.x IS NOT NULL AND c.x IS NOT NULL) AS both FROM shown s FULL JOIN cited c ON s.x = c.x AND s.node = c.node GROUP BY 1""", lambda g, f: f(g)),
    "sessionless_claims": ("SELECT 'paper/x' AS key, count(*) AS n FROM known", lambda g, f: f(g)),
    "being_written": ("SELECT count(*) AS sessions, max(ts_us) AS newest FROM ses", lambda g, f: _times("newest")(f(g))),
    "thread_lifecycle": ("""
        SELECT e.label, CASE WHEN src = 'agent:bot' THEN 'bot' ELSE session_id END AS actor FROM e LEFT JOIN ses ON src = ses.vid WHERE dst = (SELECT min(dst) FROM e WHERE label = 'SPAWNS')""", None),
    "agent_closes": ("SELECT src, dst, basis, approval_ref FROM e WHERE label = 'RESOLVES' AND src = 'agent:bot'", lambda g, f: f(g)),
    "provenance_walk": ("SELECT source AS dst, s.title, CAST(NULL AS VARCHAR) AS uri, CAST(2 AS INTEGER) AS tier, 'c' || item_id AS anchors FROM known JOIN src s ON s.vid = source WHERE known.vid = 'scope:lit:claim:b7'", lambda g, f: f(g, "scope:lit:claim:b7")),
    "artifact_history_recipe": ("SELECT dst AS artifact, string_agg(DISTINCT src, ',' ORDER BY src) AS touched_by FROM e WHERE label = 'TOUCHES' AND contains(dst, '/en/') GROUP BY 1", lambda g, f: RECIPES["artifact_history"](g, "/en/").withColumn("touched_by", F.array_join("touched_by", ","))),
    "consultation_audit": ("SELECT vid, status, (SELECT count(*) FROM e WHERE label = 'REFERENCES' AND src = vid) AS citations FROM exc", lambda g, f: f(g)),
    "claim_convergence": ("SELECT dst AS claim, count(DISTINCT src) AS sessions FROM e WHERE label = 'CONTAINS' GROUP BY 1", lambda g, f: f(g, 1)),
    "evidence_heads": (f"SELECT vid {_VALUES} FROM src WHERE vid NOT IN (SELECT dst FROM e WHERE label = 'SUPERSEDES')", lambda g, f: f(g)),
    "paper_contribution": (f"SELECT DISTINCT n.vid {_VALUES} FROM known n JOIN e r ON r.dst = n.vid AND r.label = 'RETURNS' JOIN e q ON q.dst = r.src AND q.label = 'QUERIES' WHERE n.source = 'scope:lit:source:s3'", lambda g, f: f(g, "scope:lit:source:s3").select("value", "bulk")),
    "citation_weight": ("SELECT source AS key, count(*) AS n FROM e JOIN known ON dst = known.vid WHERE label = 'REFERENCES' GROUP BY 1", lambda g, f: f(g)),
    "cold_sources": ("SELECT s.vid, (SELECT count(*) FROM e JOIN known ON dst = known.vid WHERE label = 'RETURNS' AND source = s.vid) AS returns FROM src s", lambda g, f: f(g)),
    "retrieval_audit": ("SELECT 'lit' AS scope, count(*) AS returns, count(*) FILTER (used = 'true') AS used, count(*) FILTER (used = 'false') AS ignored FROM e WHERE label = 'RETURNS'", lambda g, f: f(g)),
    "tool_examples": ("SELECT kind AS key, count(*) AS n FROM clm GROUP BY 1", lambda g, f: f(g, "main")),
}


def _lifecycle(g):
    thread = g.edges.where("label = 'SPAWNS'").agg(F.min("dst")).first()[0]
    return RECIPES["thread_lifecycle"](g, thread or "").select("label", "actor")


for _name, (_sql, _build) in _RECIPES.items():
    _register(f"recipe_{_name}", _sql, (lambda g, b=_build, n=_name: b(g, RECIPES.get(n)) if b else _lifecycle(g)))


# Recall endpoints --------------------------------------------------------------------
_register("recall_recent", "SELECT vid, session_id, ts_us AS timestamp FROM ses ORDER BY ts_us DESC LIMIT 7", lambda g: _times("timestamp")(Recall(g).recent(7).select("vid", "session_id", "timestamp")))
_register("recall_by_project", "SELECT vid, project FROM ses WHERE contains(project, '3') ORDER BY ts_us DESC LIMIT 5", lambda g: Recall(g).by_project("3", 5).select("vid", "project"))
_register(
    "recall_by_artifact",
    """, hit AS (SELECT * FROM art WHERE contains(identifier, '/fr/')), keys AS (SELECT DISTINCT repo, path FROM hit WHERE repo <> '' AND path <> '' ORDER BY repo, path LIMIT 25),
       spell AS (SELECT vid FROM hit UNION SELECT vid FROM art SEMI JOIN keys USING (repo, path)), touched AS (SELECT DISTINCT src FROM e WHERE label = 'TOUCHES' AND dst IN (SELECT vid FROM spell))
       SELECT vid, session_id FROM ses WHERE vid IN (SELECT src FROM e WHERE label = 'CONTAINS' AND dst IN (SELECT src FROM touched)) ORDER BY ts_us DESC, vid LIMIT 5""",
    lambda g: Recall(g).by_artifact("/fr/", 5).select("vid", "session_id"),
)
_register(
    "recall_spellings",
    ", hit AS (SELECT * FROM art WHERE contains(identifier, 'example.net/de')), keys AS (SELECT DISTINCT repo, path FROM hit WHERE repo <> '' AND path <> '' ORDER BY repo, path LIMIT 25) SELECT vid FROM hit UNION SELECT vid FROM art SEMI JOIN keys USING (repo, path)",
    lambda g: Recall(g).spellings("example.net/de"),
)
_OVERLAP = " + ".join(f"CAST(contains(lower(title || ' ' || description), '{w}') AS INT)" for w in WORDS)
_register(
    "recall_open_threads",
    f", w AS (SELECT *, {_OVERLAP} AS overlap FROM thr WHERE status IN ('open', 'in_progress') ORDER BY ts_us DESC, vid LIMIT {R.THREAD_WINDOW}) SELECT vid, status FROM w ORDER BY overlap DESC, ts_us DESC, vid LIMIT 10",
    lambda g: Recall(g).open_threads(topic=ASK, limit=10).select("vid", "status"),
)
_register("recall_thread", "SELECT vid, title FROM thr WHERE vid = (SELECT min(vid) FROM thr)", lambda g: Recall(g).thread(g.vertices.where("label = 'Thread'").agg(F.min("vid")).first()[0] or "").select("vid", "title"))
_register(
    "recall_open_problems",
    """, seen AS (SELECT c.vid AS claim, s.session_id, s.forked_from, s.room, s.ts_us FROM clm c JOIN ses s ON c.session = s.vid WHERE kind = 'problem' AND c.vid NOT IN (SELECT src FROM e WHERE label = 'SOLVED_BY'))
       SELECT claim, count(*) AS asserted, CAST(1 AS BIGINT) AS times, max(ts_us) AS last_seen, string_agg(DISTINCT room, ',' ORDER BY room) AS rooms FROM seen GROUP BY claim ORDER BY times DESC, last_seen DESC, claim LIMIT 15""",
    lambda g: _times("last_seen")(Recall(g).open_problems(limit=15).select("claim", "asserted", "times", "last_seen", F.array_join("rooms", ",").alias("rooms"))),
)
_register(
    "recall_exchanges",
    ", w AS (SELECT *, CAST(contains(lower(question || ' ' || coalesce(answer, '')), 'value') AS INT) + CAST(contains(lower(question || ' ' || coalesce(answer, '')), '77') AS INT) AS overlap FROM exc WHERE expert IN ('main', 'exp2') OR from_scope IN ('main', 'exp2') ORDER BY ts_us DESC, vid LIMIT 50) SELECT vid, status FROM w ORDER BY overlap DESC, ts_us DESC, vid LIMIT 8",
    lambda g: R.rerank(Recall(g, ["main", "exp2"]).of("Exchange").where(F.col("expert").isin("main", "exp2") | F.col("from_scope").isin("main", "exp2")), base=[F.coalesce("answered_at", "ts").desc_nulls_last(), F.col("vid")], relevance=X.overlap(F.concat_ws(" ", "question", "answer"), ["value", "77"]), window=R.EXCHANGE_WINDOW, limit=8).select("vid", "status"),
)
_register("recall_exchange_confined", "SELECT vid, expert FROM exc WHERE vid = (SELECT min(vid) FROM exc) AND (expert = 'exp3' OR from_scope = 'exp3')", lambda g: Recall(g, ["exp3"]).exchange(g.vertices.where("label = 'Exchange'").agg(F.min("vid")).first()[0] or "").select("vid", "expert"))
_HITS = ", ".join(f"('{w}')" for w in WORDS)
_register(
    "recall_keyword",
    f""", w(k) AS (VALUES {_HITS}), h AS (SELECT vid AS node, k, 2.0 AS s FROM ses, w WHERE contains(lower(summary), k) UNION ALL SELECT session, k, 1.0 FROM clm, w WHERE contains(lower(description), k)),
       rs AS (SELECT node, row_number() OVER (ORDER BY sum(s) DESC, sha256('{ASK}' || chr(0) || node), node) AS rank FROM h GROUP BY node HAVING count(DISTINCT k) >= 2),
       rk AS (SELECT node, row_number() OVER (ORDER BY sum(s) DESC, sha256('{ASK}' || chr(0) || node), node) AS rank FROM (SELECT vid AS node, k, 2.0 AS s FROM known, w WHERE contains(lower(text), k)) GROUP BY node HAVING count(DISTINCT k) >= 2),
       c AS (SELECT (SELECT count(*) FROM rs) AS ns, (SELECT count(*) FROM rk) AS nk), r AS (SELECT ns, CASE WHEN ns > 0 THEN least(nk, 5) ELSE nk END AS reserved FROM c),
       u AS (SELECT 'claim' AS kind, node, CASE WHEN rank <= reserved THEN rank ELSE rank + least(ns, 10 - reserved) END AS position FROM rk, r UNION ALL SELECT 'session', node, reserved + rank FROM rs, r WHERE rank <= 10 - reserved)
       SELECT kind, node, position, (SELECT title FROM known n JOIN src s ON s.vid = n.source WHERE n.vid = node) AS source_title FROM u WHERE position <= 10""",
    lambda g: Recall(g, _BOTH).keyword(ASK, 10).select("kind", "node", "position", "source_title"),
)

_register(
    "recall_consultations",
    "SELECT vid, expert, status, (SELECT count(*) FROM e WHERE label = 'REFERENCES' AND src = vid) AS citations FROM exc WHERE expert = 'exp2' OR from_scope = 'exp2' ORDER BY ts_us DESC, vid LIMIT 12",
    lambda g: _consultations(g),
)
_register("sessions_with_claims", "SELECT session, count(*) AS claims FROM clm GROUP BY 1", lambda g: Recall(g).sessions_with_claims())
_register("known_claims", "SELECT vid AS claim, session, kind, description FROM clm WHERE session = (SELECT min(vid) FROM ses)", lambda g: Recall(g).known_claims(g.vertices.where("label = 'Session'").agg(F.min("vid")).first()[0] or ""))


def _consultations(g):
    """Exchanges of one expert; the caller's grant is main, where exchanges live, and the expert's scope."""
    own = Recall(g, ["main"])
    own.scopes = ["exp2"]
    return own.consultations(12).select("vid", "expert", "status", "citations")


# Writers -------------------------------------------------------------------------------
def _now():
    return F.lit("2024-03-01").cast("timestamp")



def _opened(g):
    """Every session asks an expert and shows its first claim."""
    s = g.vertices.where("label = 'Session'")
    first = g.edges.where("label = 'CONTAINS'").groupBy(F.col("src").alias("vid")).agg(F.min("dst").alias("claim"))
    asked = s.join(first, "vid").select(F.concat(F.lit("t"), "session_id").alias("ticket"), F.col("session_id").alias("session"), F.lit("exp1").alias("expert"), F.lit("main").alias("from_scope"), F.col("summary").alias("question"), F.array("claim", "claim").alias("brief"))
    v, e = WR.open_exchanges(asked, s, _now())
    return v.select(F.lit("vertex").alias("what"), "vid", F.col("status").alias("detail")).unionByName(e.select(F.col("label").alias("what"), F.concat_ws(">", "src", "dst").alias("vid"), F.coalesce(F.try_element_at("props", F.lit("role")), F.lit("")).alias("detail")))


_register("write_open_exchanges", """SELECT 'vertex' AS what, 'scope:main:exchange:t' || session_id AS vid, 'open' AS detail FROM ses UNION ALL SELECT 'CONSULTS', vid || '>scope:main:exchange:t' || session_id, '' FROM ses
UNION ALL SELECT 'REFERENCES', 'scope:main:exchange:t' || conv_id || '>' || min(vid), 'brief' FROM clm GROUP BY conv_id""", _opened)


def _closed(g):
    """All exchanges are answered at once; those of exp3 are refused, and those already answered stay."""
    x = g.vertices.where("label = 'Exchange'")
    answers = x.select(F.col("vid").alias("exchange"), F.lit("yes").alias("answer"), F.array(F.lit("scope:lit:claim:b1"), F.lit("scope:lit:claim:b1")).alias("cited"), F.lit("agent").alias("agent"))
    refused = x.where("expert = 'exp3'").select(F.col("vid").alias("subject"))
    v, e = WR.close_exchanges(answers, x, refused, _now())
    return v.join(e.select(F.col("src").alias("vid"), "dst"), "vid").select("vid", "status", "dst")


_register("write_close_exchanges", "SELECT vid, 'answered' AS status, 'scope:lit:claim:b1' AS dst FROM exc WHERE status = 'open' AND expert <> 'exp3'", _closed)


def _threads_closed(g):
    closes = g.vertices.where("label = 'Thread'").select(F.col("vid").alias("thread"), F.lit("op").alias("agent"), F.lit("resolved").alias("status"), F.col("title").alias("basis"), F.lit("r1").alias("approval_ref"))
    gone = closes.select(F.concat("thread", F.lit("-gone")).alias("thread"), "agent", "status", "basis", "approval_ref")
    v, e, missing = WR.close_threads(closes.unionByName(gone), g.vertices, _now())
    ends = e.select(F.col("dst").alias("vid"), F.try_element_at("props", F.lit("basis")).alias("basis"))
    return v.join(ends, "vid").select("vid", "status", "basis").unionByName(missing.select(F.col("thread").alias("vid"), F.lit("missing").alias("status"), F.lit("").alias("basis")))


_register("write_close_threads", "SELECT vid, 'resolved' AS status, title AS basis FROM thr UNION ALL SELECT vid || '-gone', 'missing', '' FROM thr", _threads_closed)


def _landed(g):
    tr = g.vertices.where("label = 'Trace'").select(F.element_at(F.split("vid", ":"), -1).alias("trace_id"), F.lit("main").alias("trace_scope"), "session_id", "tool", "injected_chars", "returned_count", "ts")
    back = g.edges.where("label = 'RETURNS'").select(F.element_at(F.split("src", ":"), -1).alias("trace_id"), F.col("dst").alias("node"), (F.try_element_at("props", F.lit("used")) == "true").alias("used"))
    unknown = back.select("trace_id", F.concat("node", F.lit("-gone")).alias("node"), "used")
    sessions = g.vertices.where("label = 'Session'")
    v, e = WR.land_traces(tr, back.unionByName(unknown), sessions, g.vertices, _now())
    return v.groupBy(F.lit("Trace").alias("what")).agg(F.count("*").alias("n"), F.sum("injected_chars").alias("chars")).unionByName(e.groupBy(F.concat_ws(" ", "label", "dst_label", F.try_element_at("props", F.lit("used"))).alias("what")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("chars")))


_register("write_land_traces", "SELECT 'Trace' AS what, count(*) AS n, CAST(sum(cents) AS BIGINT) AS chars FROM trc UNION ALL SELECT 'QUERIES Trace', count(*), 0 FROM e WHERE label = 'QUERIES' UNION ALL SELECT concat_ws(' ', 'RETURNS Claim', used), count(*), 0 FROM e WHERE label = 'RETURNS' GROUP BY used", _landed)

# Contract -----------------------------------------------------------------------------
_register("contract_vertices", "SELECT 'provenance-hole' AS rule, vid AS subject, '' AS detail FROM v WHERE tier IS NULL UNION ALL SELECT 'laundered-claim', vid, CAST(tier AS VARCHAR) FROM v WHERE kind = 'paper/x' AND tier < 2", lambda g: C.check_vertices(g.vertices))
_register("contract_edges", "SELECT 'illegal-crossing' AS rule, label || ' ' || src || ' ' || dst AS subject, '' AS detail FROM e WHERE label = 'SOLVED_BY' AND dst LIKE 'scope:lit:%' UNION ALL SELECT 'uncited-close', label || ' ' || src || ' ' || dst, '' FROM e WHERE src = 'agent:bot' AND approval_ref IS NULL", lambda g: C.check_edges(g.edges))
_register("contract_exchanges", "SELECT 'answered-uncited' AS rule, vid AS subject, '' AS detail FROM exc WHERE status = 'answered' AND vid NOT IN (SELECT src FROM e WHERE label = 'REFERENCES')", lambda g: C.check_exchanges(g.vertices, g.edges))
_register("contract_orphans", "SELECT 'orphan' AS rule, vid AS subject, label AS detail FROM v WHERE vid NOT IN (SELECT src FROM e UNION ALL SELECT dst FROM e) AND NOT (label = 'Exchange' AND status = 'open')", lambda g: C.check_orphans(g.vertices, g.edges))


def _evidence(g):
    """Half the sources' bytes are retained."""
    blobs = g.vertices.where("label = 'Source' AND right(vid, 1) < '5'").select(F.col("content_hash").alias("hash"))
    return C.check_evidence(g.vertices, blobs)


_register("contract_evidence", "SELECT 'source-hash' AS rule, vid AS subject, '' AS detail FROM src WHERE right(vid, 1) = '7' UNION ALL SELECT 'evidence-lost', vid, sha256(vid) FROM src WHERE right(vid, 1) >= '5' AND right(vid, 1) <> '7'", _evidence)
_register("contract_census", "SELECT 'vertex' AS kind, label, count(*) AS n FROM v GROUP BY label UNION ALL SELECT 'edge', label, count(*) FROM e GROUP BY label", lambda g: C.census(g.vertices, g.edges))

# The query language ----------------------------------------------------------------------
_register("traversal_count_zero", f"SELECT vid {_VALUES} FROM clm WHERE vid NOT IN (SELECT src FROM e WHERE label = 'SOLVED_BY')", lambda g: T(g).V().has_label("Claim").has("scope", "main").where(lambda x: x.out("SOLVED_BY").count().is_(0)).df)
_register("traversal_local_count", "SELECT n AS key, count(*) AS n FROM (SELECT (SELECT count(*) FROM e WHERE src = vid AND label = 'CONTAINS') AS n FROM ses) GROUP BY 1", lambda g: T(g).V().has_label("Session").local(lambda x: x.out("CONTAINS").count()).group_count())
_register("traversal_order_range", "SELECT vid AS value, CAST(1 AS BIGINT) AS bulk FROM exc ORDER BY expert DESC, question, vid LIMIT 15 OFFSET 5", lambda g: T(g).V().has_label("Exchange").order_by(("expert", True), ("question", False)).range_(5, 20).df)
_register("traversal_side_effect", "SELECT source AS value, count(*) AS bulk FROM e JOIN known ON dst = known.vid WHERE label = 'RETURNS' GROUP BY 1", lambda g: _cap(g))
_register("traversal_subgraph", "SELECT label, count(*) AS n FROM v WHERE vid IN (SELECT src FROM e WHERE label = 'SOLVED_BY' UNION ALL SELECT dst FROM e WHERE label = 'SOLVED_BY') GROUP BY 1", lambda g: T(g).E().has("label", "SOLVED_BY").subgraph().vertices.groupBy("label").agg(F.count("*").alias("n")))
_register("traversal_tree", "SELECT CAST(depth AS INTEGER) AS depth, node, count(*) AS n FROM (SELECT unnest([0, 1, 2]) AS depth, unnest([s.vid, s.dst, s.dst2]) AS node FROM (SELECT a.src AS vid, a.dst, b.dst AS dst2 FROM e a JOIN e b ON b.src = a.dst AND b.label = 'SOLVED_BY' WHERE a.label = 'CONTAINS') s) GROUP BY ALL", lambda g: T(g).V().has_label("Session").with_path().out("CONTAINS").out("SOLVED_BY").tree().groupBy("depth", "node").agg(F.sum("n").alias("n")))
_register("traversal_properties", "SELECT key, count(*) AS n FROM (SELECT CASE WHEN basis IS NOT NULL THEN 'basis' END AS key FROM e UNION ALL SELECT CASE WHEN approval_ref IS NOT NULL THEN 'approval_ref' END FROM e UNION ALL SELECT CASE WHEN basis IS NOT NULL THEN 'closed_at' END FROM e) WHERE key IS NOT NULL GROUP BY 1", lambda g: T(g).E().has("label", "RESOLVES").properties().key().group_count())
_register("traversal_choose", "SELECT dst AS key, count(*) AS n FROM (SELECT CASE kind WHEN 'problem' THEN (SELECT min(dst) FROM e WHERE label = 'SOLVED_BY' AND src = vid) WHEN 'solution' THEN session ELSE vid END AS dst FROM clm) WHERE dst IS NOT NULL GROUP BY 1", lambda g: T(g).V().has_label("Claim").has("scope", "main").choose_option("kind", {"problem": lambda x: x.out("SOLVED_BY"), "solution": lambda x: x.in_("CONTAINS")}).group_count())


def _cap(g):
    held = {}
    t = T(g).V().has_label("Trace").out("RETURNS").out("DERIVED_FROM").aggregate(held, "x")
    return t.cap(held, "x")


@query("""
WITH c AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS m, o_custkey FROM orders)
SELECT 'o' || (SELECT o_orderkey FROM c d WHERE d.o_custkey = c.o_custkey AND d.n = d.m) AS value, CAST(m - 1 AS INTEGER) AS loops FROM c WHERE n = 1 AND m > 1
""")
def traversal_repeat(t):
    """From each customer's first order along their orders to the last one, however many there are."""
    from pyspark.sql.window import Window as W

    from ..schema import EDGE, VERTEX
    from ..sources.store import Graph

    name = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    nxt = F.lead(name).over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = t.orders.select(name.alias("vid"), nxt.alias("next"))
    v = rows.select(*[{"vid": F.col("vid"), "label": F.lit("Thread")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in VERTEX])
    e = rows.where("next IS NOT NULL").select(*[{"label": F.lit("BLOCKS"), "src": F.col("vid"), "dst": F.col("next")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EDGE])
    # Written once: every round reads edges, and orders are put in sequence for them once.
    first = T(Graph(settle(v), settle(e))).V().not_(lambda x: x.in_("BLOCKS"))
    start = first._next(settle(first.frame)).where(lambda x: x.out("BLOCKS"))
    walk = start.repeat(lambda x: x.out("BLOCKS"), until=lambda x: x.not_(lambda y: y.out("BLOCKS")), count_loops=True)
    return walk.df.select("value", "loops")
