"""A memory graph made of the driver's tables, in Spark and in SQL, for queries that call the endpoints as they are.

Conversations are sessions and their turns claims, benchmark passages knowledge
claims of ten sources, pages artifacts, labelled documents threads, errors among
the events exchanges and views traces. The SQL names the same vertices and edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.iterate import settle
from ..schema import EDGE, VERTEX
from ..sources.store import Graph
from .registry import Tables

#: The first moment of the graph; sessions and threads follow by minutes of their number.
BEGIN = "2024-01-01"


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _n(c: str) -> Column:
    return F.col(c).cast("string")


def _later(c: str) -> Column:
    return F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col(c) * 60_000_000)


def _vertices(df: DataFrame, label: str, **columns: Column) -> DataFrame:
    columns = {"label": F.lit(label), **columns}
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in VERTEX])


def _edges(df: DataFrame, label: str, src: Column, dst: Column, ends: tuple[str, str], **props: Column) -> DataFrame:
    held = F.map_filter(F.create_map(*[x for k, c in props.items() for x in (F.lit(k), c.cast("string"))]), lambda k, v: v.isNotNull()) if props else F.lit(None)
    values = {"label": F.lit(label), "src": src, "dst": dst, "src_label": F.lit(ends[0]), "dst_label": F.lit(ends[1]), "props": held}
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in EDGE])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def k() -> Column:
    """The number in an event's properties."""
    return F.get_json_object("props", "$.k").cast("long")


def memory_graph(t: Tables) -> Graph:
    turns = t.conversations.select("conv_id", "turn", "role", "text")
    conv = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("opening"))
    session, claim = _text("scope:main:session:", _n("conv_id")), _text("scope:main:claim:", _n("conv_id"), "-", _n("turn"))
    stamp = {"scope": F.lit("main"), "tier": F.lit(1), "source": F.lit("session"), "ingested_at": F.lit(BEGIN).cast("timestamp")}
    known = t.benchmark.select("item_id", "text").withColumns({"vid": _text("scope:lit:claim:b", _n("item_id")), "from": _text("scope:lit:source:s", (F.col("item_id") % 10).cast("string"))})
    pages = t.pages.select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("ident"))
    artifact, slash = _text("artifact:", F.col("ident")), F.instr("ident", "/")
    docs = t.labels.join(t.documents.select("doc_id", "lang", "source", F.substring("text", 1, 200).alias("text")), "doc_id")
    thread = _text("scope:main:thread:d", _n("doc_id"))
    status = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 0, "open").otherwise("in_progress")).otherwise(F.when(F.col("toxic") == 0, "resolved").otherwise("abandoned"))
    docs = docs.withColumn("status", status)
    e = t.events.withColumns({"k": k(), "ts": F.col("ts").cast("timestamp"), "cents": F.round(F.col("value") * 100).cast("long"), "item": F.col("event_id") % 40})
    asked, seen = e.where("event_type = 'error'"), e.where("event_type = 'view'")
    exchange, trace = _text("scope:main:exchange:", _n("event_id")), _text("scope:main:trace:", _n("event_id"))
    kind = F.when(F.col("role") == "user", "problem").when(F.col("role") == "assistant", "solution").otherwise("decision")
    source = known.select("from").distinct()
    v = [
        _vertices(conv, "Session", **stamp, vid=session, session_id=_n("conv_id"), summary=F.col("opening"), timestamp=_later("conv_id"), project=_text("proj", (F.col("conv_id") % 7).cast("string")), room=_text("room", (F.col("conv_id") % 5).cast("string")), forked_from=F.when(F.col("conv_id") % 3 == 1, (F.col("conv_id") - 1).cast("string"))),
        _vertices(turns, "Claim", **{**stamp, "tier": F.when(F.col("role") != "system", 1)}, vid=claim, kind=kind, description=F.col("text")),
        _vertices(known, "Claim", **{**stamp, "scope": F.lit("lit"), "tier": F.when(F.length("text") > 300, 1).otherwise(2)}, vid=F.col("vid"), kind=F.lit("paper/x"), description=F.col("text"), external=F.lit(True)),
        _vertices(source, "Source", **{**stamp, "scope": F.lit("lit"), "tier": F.lit(2)}, vid=F.col("from"), title=_text("Source ", F.substring("from", -1, 1)), content_hash=F.when(~F.col("from").endswith("7"), F.sha2("from", 256))),
        _vertices(pages.select("ident").distinct(), "Artifact", **{**stamp, "scope": F.lit(None)}, vid=artifact, identifier=F.col("ident"), repo=F.expr("substring(ident, 1, instr(ident, '/') - 1)"), path=F.expr("CASE WHEN instr(ident, '/') > 0 THEN substring(ident, instr(ident, '/') + 1) END")),
        _vertices(docs, "Thread", **{**stamp, "ingested_at": _later("doc_id")}, vid=thread, thread_id=_text("d", _n("doc_id")), status=F.col("status"), title=_text(F.col("lang"), " ", F.col("source")), description=F.col("text"), project=_text("proj", (F.col("doc_id") % 7).cast("string"))),
        _vertices(t.spark.range(1), "Agent", **{**stamp, "scope": F.lit(None)}, vid=F.lit("agent:bot"), name=F.lit("bot")),
        _vertices(asked, "Exchange", **stamp, vid=exchange, expert=_text("exp", (F.col("user_id") % 4).cast("string")), from_scope=F.when(F.col("user_id") % 2 == 0, "main").otherwise("exp1"), status=F.when(F.col("k") >= 50, "answered").otherwise("open"), question=_text("how about ", F.col("props")), answer=F.when(F.col("k") >= 50, _text("value ", F.col("cents").cast("string"))), answered_at=F.when(F.col("k") >= 50, F.col("ts")), ts=F.col("ts")),
        _vertices(seen, "Trace", **stamp, vid=trace, session_id=_n("user_id"), tool=F.lit("memory_recall"), injected_chars=F.col("cents"), returned_count=F.lit(1), ts=F.col("ts")),
    ]
    has_session = conv.select(F.col("conv_id").alias("user_id"))
    known_item = known.select(F.col("item_id").alias("item"), F.col("vid").alias("node"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role")).where("next_role = 'assistant'")
    said = _text("scope:main:session:", _n("user_id"))
    used = F.when(F.col("k") % 10 != 0, F.when(F.col("k") >= 60, "true").otherwise("false"))
    ones = [
        _edges(turns, "CONTAINS", session, claim, ("Session", "Claim")),
        _edges(turns.where("role = 'user'").join(after, ["conv_id", "turn"]), "SOLVED_BY", claim, _text("scope:main:claim:", _n("conv_id"), "-", (F.col("turn") + 1).cast("string")), ("Claim", "Claim")),
        _edges(turns.where("role = 'assistant'").join(known, F.col("conv_id") == F.col("item_id")), "SOLVED_BY", claim, F.col("vid"), ("Claim", "Claim")),
        _edges(turns.join(pages, F.col("conv_id") == F.col("page_id")), "TOUCHES", claim, artifact, ("Claim", "Artifact")),
        _edges(known, "DERIVED_FROM", F.col("vid"), F.col("from"), ("Claim", "Source"), anchors=_text("c", _n("item_id"))),
        _edges(source.where("right(from, 1) >= '5'"), "SUPERSEDES", F.col("from"), F.expr("'scope:lit:source:s' || CAST(CAST(right(from, 1) AS INT) - 5 AS STRING)"), ("Source", "Source")),
        _edges(docs.join(conv, F.col("doc_id") == F.col("conv_id")), "SPAWNS", session, thread, ("Session", "Thread")),
        _edges(docs.where("status = 'resolved'").join(conv, F.col("doc_id") == F.col("conv_id")), "RESOLVES", session, thread, ("Session", "Thread")),
        _edges(docs.where("status = 'abandoned'"), "RESOLVES", F.lit("agent:bot"), thread, ("Agent", "Thread"), basis=F.lit("stale"), approval_ref=F.when(F.col("lang") == "en", _n("doc_id")), closed_at=F.lit("2024-02-01")),
        _edges(asked.join(has_session, "user_id"), "CONSULTS", said, exchange, ("Session", "Exchange")),
        _edges(asked.where("k >= 50 AND cents % 3 <> 0").join(known_item, "item"), "REFERENCES", exchange, F.col("node"), ("Exchange", "Claim"), role=F.lit("citation")),
        _edges(seen.join(has_session, "user_id"), "QUERIES", said, trace, ("Session", "Trace")),
        _edges(seen.join(known_item, "item"), "RETURNS", trace, F.col("node"), ("Trace", "Claim"), used=used),
    ]
    # Written once: what reads the graph plans over two tables and not over their making.
    return Graph(settle(_union(v)), settle(_union(ones)))


_PAGE = "regexp_extract(url, '://([^?#]*)', 1)"

#: The same graph as CTEs: v has the columns that the queries read, e the edges with their properties as columns.
MEMORY_SQL = f"""
conv AS (SELECT conv_id, arg_min(text, turn) AS opening FROM conversations GROUP BY 1),
known AS (SELECT item_id, text, 'scope:lit:claim:b' || item_id AS vid, 'scope:lit:source:s' || (item_id % 10) AS source FROM benchmark),
page AS (SELECT page_id, {_PAGE} AS ident FROM pages),
docs AS (SELECT doc_id, lang, d.source, substr(d.text, 1, 200) AS text, CASE WHEN quality = 1 THEN CASE WHEN toxic = 0 THEN 'open' ELSE 'in_progress' END WHEN toxic = 0 THEN 'resolved' ELSE 'abandoned' END AS status FROM labels JOIN documents d USING (doc_id)),
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents, event_id % 40 AS item FROM events),
ses AS (SELECT 'scope:main:session:' || conv_id AS vid, conv_id, CAST(conv_id AS VARCHAR) AS session_id, opening AS summary, 1704067200000000 + conv_id * 60000000 AS ts_us, 'proj' || (conv_id % 7) AS project, 'room' || (conv_id % 5) AS room, CASE WHEN conv_id % 3 = 1 THEN CAST(conv_id - 1 AS VARCHAR) END AS forked_from FROM conv),
clm AS (SELECT 'scope:main:claim:' || conv_id || '-' || turn AS vid, conv_id, turn, role, 'scope:main:session:' || conv_id AS session, CASE role WHEN 'user' THEN 'problem' WHEN 'assistant' THEN 'solution' ELSE 'decision' END AS kind, text AS description FROM conversations),
src AS (SELECT DISTINCT source AS vid, 'Source ' || right(source, 1) AS title FROM known),
art AS (SELECT DISTINCT 'artifact:' || ident AS vid, ident AS identifier, CASE WHEN instr(ident, '/') > 0 THEN substr(ident, 1, instr(ident, '/') - 1) ELSE '' END AS repo, CASE WHEN instr(ident, '/') > 0 THEN substr(ident, instr(ident, '/') + 1) END AS path FROM page),
thr AS (SELECT 'scope:main:thread:d' || doc_id AS vid, doc_id, status, lang, lang || ' ' || source AS title, text AS description, 'proj' || (doc_id % 7) AS project, 1704067200000000 + doc_id * 60000000 AS ts_us FROM docs),
exc AS (SELECT 'scope:main:exchange:' || event_id AS vid, user_id, item, k, cents, 'exp' || (user_id % 4) AS expert, CASE WHEN user_id % 2 = 0 THEN 'main' ELSE 'exp1' END AS from_scope, CASE WHEN k >= 50 THEN 'answered' ELSE 'open' END AS status, 'how about ' || props AS question, CASE WHEN k >= 50 THEN 'value ' || cents END AS answer, epoch_us(ts) AS ts_us FROM ev WHERE event_type = 'error'),
trc AS (SELECT 'scope:main:trace:' || event_id AS vid, user_id, item, k, cents, epoch_us(ts) AS ts_us, CASE WHEN k % 10 <> 0 THEN CASE WHEN k >= 60 THEN 'true' ELSE 'false' END END AS used FROM ev WHERE event_type = 'view'),
v AS (
  SELECT vid, 'Session' AS label, 'main' AS scope, NULL AS kind, 1 AS tier, NULL AS status FROM ses
  UNION ALL SELECT vid, 'Claim', 'main', kind, CASE WHEN role <> 'system' THEN 1 END, NULL FROM clm
  UNION ALL SELECT vid, 'Claim', 'lit', 'paper/x', CASE WHEN length(text) > 300 THEN 1 ELSE 2 END, NULL FROM known
  UNION ALL SELECT vid, 'Source', 'lit', NULL, 2, NULL FROM src
  UNION ALL SELECT vid, 'Artifact', NULL, NULL, 1, NULL FROM art
  UNION ALL SELECT vid, 'Thread', 'main', NULL, 1, status FROM thr
  UNION ALL SELECT 'agent:bot', 'Agent', NULL, NULL, 1, NULL
  UNION ALL SELECT vid, 'Exchange', 'main', NULL, 1, status FROM exc
  UNION ALL SELECT vid, 'Trace', 'main', NULL, 1, NULL FROM trc),
e AS (
  SELECT 'CONTAINS' AS label, session AS src, vid AS dst, NULL AS role, NULL AS used, NULL AS basis, NULL AS approval_ref FROM clm
  UNION ALL SELECT 'SOLVED_BY', a.vid, b.vid, NULL, NULL, NULL, NULL FROM clm a JOIN clm b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'
  UNION ALL SELECT 'SOLVED_BY', a.vid, b.vid, NULL, NULL, NULL, NULL FROM clm a JOIN known b ON a.conv_id = b.item_id AND a.role = 'assistant'
  UNION ALL SELECT 'TOUCHES', c.vid, 'artifact:' || ident, NULL, NULL, NULL, NULL FROM clm c JOIN page ON conv_id = page_id
  UNION ALL SELECT 'DERIVED_FROM', vid, source, NULL, NULL, NULL, NULL FROM known
  UNION ALL SELECT 'SUPERSEDES', vid, 'scope:lit:source:s' || (CAST(right(vid, 1) AS INT) - 5), NULL, NULL, NULL, NULL FROM src WHERE right(vid, 1) >= '5'
  UNION ALL SELECT 'SPAWNS', s.vid, t.vid, NULL, NULL, NULL, NULL FROM thr t JOIN ses s ON conv_id = doc_id
  UNION ALL SELECT 'RESOLVES', s.vid, t.vid, NULL, NULL, NULL, NULL FROM thr t JOIN ses s ON conv_id = doc_id WHERE status = 'resolved'
  UNION ALL SELECT 'RESOLVES', 'agent:bot', vid, NULL, NULL, 'stale', CASE WHEN lang = 'en' THEN CAST(doc_id AS VARCHAR) END FROM thr WHERE status = 'abandoned'
  UNION ALL SELECT 'CONSULTS', s.vid, x.vid, NULL, NULL, NULL, NULL FROM exc x JOIN ses s ON user_id = conv_id
  UNION ALL SELECT 'REFERENCES', x.vid, n.vid, 'citation', NULL, NULL, NULL FROM exc x JOIN known n ON item = item_id WHERE k >= 50 AND cents % 3 <> 0
  UNION ALL SELECT 'QUERIES', s.vid, t.vid, NULL, NULL, NULL, NULL FROM trc t JOIN ses s ON user_id = conv_id
  UNION ALL SELECT 'RETURNS', t.vid, n.vid, NULL, used, NULL, NULL FROM trc t JOIN known n ON item = item_id)
"""
