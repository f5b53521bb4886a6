"""Traversal texts over the memory graph, refused texts with their reasons, deltas of a store, merged sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.query_text import query_text, refusal
from .memory_queries import _VALUES, _register
from .registry import query

TEXTS = {
    "query_text_hops": ("g.V().hasLabel('Session').out('CONTAINS').out('SOLVED_BY').dedup().count()", "SELECT count(*) AS value, CAST(1 AS BIGINT) AS bulk FROM (SELECT DISTINCT b.dst FROM e a JOIN e b ON b.src = a.dst AND b.label = 'SOLVED_BY' WHERE a.label = 'CONTAINS')"),
    "query_text_used": ("g.V().hasLabel('Trace').outE('RETURNS').has('used', 'false').inV().groupCount().by(id)", "SELECT dst AS key, count(*) AS n FROM e WHERE label = 'RETURNS' AND used = 'false' GROUP BY 1"),
    "query_text_unsolved": ("g.V().hasLabel('Claim').has('kind', 'problem').not(__.out('SOLVED_BY')).or(__.in('CONTAINS'), __.out('TOUCHES'))", f"SELECT vid {_VALUES} FROM clm WHERE kind = 'problem' AND vid NOT IN (SELECT src FROM e WHERE label = 'SOLVED_BY')"),
    "query_text_order": ("g.V().hasLabel('Exchange').order().by('expert', desc).by('question').range(5, 20)", "SELECT vid AS value, CAST(1 AS BIGINT) AS bulk FROM exc ORDER BY expert DESC, question, vid LIMIT 15 OFFSET 5"),
    "query_text_choose": ("g.V().hasLabel('Claim').has('scope', 'main').choose(values('kind')).option('problem', __.out('SOLVED_BY')).option('solution', __.in('CONTAINS')).groupCount()", "SELECT dst AS key, count(*) AS n FROM (SELECT CASE kind WHEN 'problem' THEN (SELECT min(dst) FROM e WHERE label = 'SOLVED_BY' AND src = vid) WHEN 'solution' THEN session ELSE vid END AS dst FROM clm) WHERE dst IS NOT NULL GROUP BY 1"),
    "query_text_local": ("g.V().hasLabel('Session').local(__.out('CONTAINS').count()).groupCount()", "SELECT n AS key, count(*) AS n FROM (SELECT (SELECT count(*) FROM e WHERE src = vid AND label = 'CONTAINS') AS n FROM ses) GROUP BY 1"),
    "query_text_repeat": ("g.V().hasLabel('Session').repeat(__.out('CONTAINS', 'SOLVED_BY')).times(2).groupCount().by(label)", "SELECT d.label AS key, count(*) AS n FROM e a JOIN e b ON b.src = a.dst AND b.label IN ('CONTAINS', 'SOLVED_BY') JOIN v d ON d.vid = b.dst WHERE a.label = 'CONTAINS' GROUP BY 1"),
    "query_text_match": ("g.V().hasLabel('Session').match(__.as('s').out('CONTAINS').as('c'), __.as('c').out('SOLVED_BY').as('d'), __.as('s').out('CONTAINS').as('d')).select('s', 'd').dedup('s', 'd').count()", "SELECT count(*) AS value, CAST(1 AS BIGINT) AS bulk FROM (SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON b.src = a.dst AND b.label = 'SOLVED_BY' JOIN e c ON c.src = a.src AND c.dst = b.dst AND c.label = 'CONTAINS' WHERE a.label = 'CONTAINS')"),
}

for _name, (_text, _sql) in TEXTS.items():
    _register(_name, _sql, lambda g, text=_text: query_text(g, text))

#: Texts that are refused, and a part of the reason.
REFUSED = {
    "h.V()": "starts with g.",
    "g.V().drop()": "mutating",
    "g.addV('Claim')": "mutating",
    "g.V().where(__.addE('X'))": "mutating",
    "g.V().map{it}": "not a chain",
    "g.V().program(x)": "mutating",
    "g.V().__class__": "starts with g.",
    "g.V().explode('x')": "unknown or refused step explode",
    "g.V().has('a', open('x'))": "takes no walk",
    "g.V().times(2)": "takes no times",
    "g.V().repeat(__.out())": "times or until",
    "g.V().valueMap()": "names of properties",
    "g.V()" + ".out()" * 400: "characters",
}


def _refusals(g):
    rows = [(text[:40], (lambda why, part=part: "refused" if why and part in why else f"{why}")(refusal(g, text))) for text, part in REFUSED.items()]
    asked = g.vertices.sparkSession.createDataFrame(rows, "text string, answer string")
    return asked.groupBy("answer").agg(F.count("*").alias("n")).crossJoin(g.vertices.agg(F.count("*").alias("vertices")))


_register("query_text_refused", f"SELECT 'refused' AS answer, CAST({len(REFUSED)} AS BIGINT) AS n, count(*) AS vertices FROM v", _refusals)


def _deltas(g):
    """A base, three deltas around a compaction: a changed column, new vertices, edge properties beside the old ones."""
    import uuid

    from ..operators.iterate import settle, shared_folder
    from ..sources.store import DeltaStore, Graph

    spark = g.vertices.sparkSession
    g = Graph(settle(g.vertices), settle(g.edges))
    store = DeltaStore(spark, f"{shared_folder(spark)}/deltas-{uuid.uuid4().hex}", buckets=4)
    store.create(g)
    store.append(g.vertices.where("label = 'Thread'").select("vid", F.lit("resolved").alias("status")))
    store.compact()
    sessions = g.vertices.where("label = 'Session'")
    store.append(sessions.select(F.concat(F.lit("extra:"), "vid").alias("vid"), F.lit("Artifact").alias("label"), F.lit("main").alias("scope")))
    marked = g.edges.where("label = 'RESOLVES'").withColumn("props", F.create_map(F.lit("checked"), F.lit("yes")))
    store.append(edges=marked)
    store.append(edges=marked.withColumn("props", F.create_map(F.lit("seen"), F.lit("too"))))
    now = store.read()
    has = lambda k: F.try_element_at("props", F.lit(k)).isNotNull()
    v = now.vertices.groupBy(F.concat_ws(" ", "label", F.when(F.col("label") == "Thread", F.col("status"))).alias("what")).agg(F.count("*").alias("n"))
    e = now.edges.groupBy(F.concat_ws(" ", "label", F.when(has("checked") & has("seen"), "checked"), F.when(has("basis"), "basis")).alias("what")).agg(F.count("*").alias("n"))
    return v.unionByName(e)


_register("store_deltas", """
SELECT CASE label WHEN 'Thread' THEN 'Thread resolved' ELSE label END AS what, count(*) + CASE label WHEN 'Artifact' THEN (SELECT count(*) FROM ses) ELSE 0 END AS n FROM v GROUP BY label
UNION ALL SELECT label || CASE label WHEN 'RESOLVES' THEN ' checked' ELSE '' END || CASE WHEN basis IS NOT NULL THEN ' basis' ELSE '' END, count(*) FROM e GROUP BY 1
""", _deltas)


@query("""
WITH d AS (SELECT event_type, date_trunc('month', ts) AS month, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, month, n, TRUE AS distinct_within, TRUE AS quantiles_within FROM d
""")
def sketch_windows(t):
    """Daily sketches merged by month; whether the estimates keep the stated error against exact counts and ranks."""
    from ..functions import stats as S

    ranks = [0.1, 0.5, 0.9]
    e = t.events.select("event_type", F.col("user_id").alias("who"), F.col("value").alias("x"), F.date_trunc("day", "ts").alias("day"))
    daily = S.sketches(e, ["event_type", "day"], distinct="who", values="x").withColumn("month", F.date_trunc("month", "day"))
    found = S.merged_sketches(daily, ["event_type", "month"], ranks)
    rows = e.select("event_type", F.date_trunc("month", "day").alias("month"), "who", "x").join(found, ["event_type", "month"])
    below = [F.count_if(F.col("x") < F.col("quantiles")[i]).alias(f"below{i}") for i in range(len(ranks))]
    upto = [F.count_if(F.col("x") <= F.col("quantiles")[i]).alias(f"upto{i}") for i in range(len(ranks))]
    exact = rows.groupBy("event_type", "month").agg(F.count_distinct("who").alias("who"), F.count("x").alias("m"), F.first("n").alias("n"), F.first("distinct").alias("distinct"), *below, *upto)
    near = F.abs(F.col("distinct") - F.col("who")) <= 4 * S.DISTINCT_ERROR * F.col("who") + 1
    held = F.lit(True)
    for i, r in enumerate(ranks):
        held = held & (F.col(f"below{i}") <= (r + S.RANK_ERROR) * F.col("m") + 1) & (F.col(f"upto{i}") >= (r - S.RANK_ERROR) * F.col("m") - 1)
    return exact.select("event_type", "month", "n", near.alias("distinct_within"), held.alias("quantiles_within"))
