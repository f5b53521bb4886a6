"""The stored questions, each a named traversal or plan over a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import scope_of
from ..operators.traversal import T, containing, eq, matching
from ..sources.store import Graph

RECIPES: dict[str, Callable[..., DataFrame]] = {}


def recipe(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    RECIPES[f.__name__] = f
    return f


def _prop(name: str):
    return F.try_element_at("props", F.lit(name))


@recipe
def graph_census(g: Graph) -> DataFrame:
    return T(g).V().group_count("label")


@recipe
def recent_sessions(g: Graph, scope: str, n: int = 3) -> DataFrame:
    return T(g).V().has_label("Session").has("scope", scope).order("timestamp", desc=True).limit(n).df


@recipe
def claims_mentioning(g: Graph, word: str) -> DataFrame:
    import re

    return T(g).V().has_label("Claim").has("description", matching("(?i)" + re.escape(word))).count().df


@recipe
def orphan_vertices(g: Graph) -> DataFrame:
    return T(g).V().not_(lambda t: t.both_e()).df


@recipe
def scope_census(g: Graph, before: str) -> DataFrame:
    s = g.vertices.where("label = 'Session'")
    return s.groupBy("scope").agg(F.count("*").alias("sessions"), F.count_if(F.col("timestamp") < F.lit(before).cast("timestamp")).alias("before")).orderBy("scope")


@recipe
def answered_by(g: Graph, expert: str, n: int = 10) -> DataFrame:
    return T(g).V().has_label("Exchange").has("expert", expert).has("status", "answered").order("answered_at", desc=True).limit(n).df


@recipe
def taken_part(g: Graph, scope: str) -> DataFrame:
    return T(g).V().has_label("Exchange").or_(lambda t: t.has("expert", scope), lambda t: t.has("from_scope", scope)).df


@recipe
def session_subgraph(g: Graph, session: str) -> DataFrame:
    e = g.edges.where(F.col("src") == session)
    return e.groupBy("label").agg(F.count("*").alias("n"))


@recipe
def witnessed_and_used(g: Graph) -> DataFrame:
    """For each exchange: what its session was shown, what the answer cites, and both."""
    e = g.edges
    shown = e.where("label = 'CONSULTS'").select(F.col("src").alias("s"), F.col("dst").alias("x")).join(e.where("label = 'QUERIES'").select(F.col("src").alias("s"), F.col("dst").alias("t")), "s").join(e.where("label = 'RETURNS'").select(F.col("src").alias("t"), F.col("dst").alias("node")), "t").select("x", "node").distinct()
    cited = e.where("label = 'REFERENCES'").where(_prop("role") == "citation").select(F.col("src").alias("x"), F.col("dst").alias("node")).distinct()
    both = shown.withColumn("a", F.lit(1)).join(cited.withColumn("b", F.lit(1)), ["x", "node"], "full_outer")
    return both.groupBy(F.col("x").alias("exchange")).agg(F.count("a").alias("shown"), F.count("b").alias("cited"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


@recipe
def sessionless_claims(g: Graph) -> DataFrame:
    return T(g).V().has_label("Claim").not_(lambda t: t.in_("CONTAINS")).group_count("kind")


@recipe
def being_written(g: Graph) -> DataFrame:
    return g.vertices.where("label = 'Session'").agg(F.count("*").alias("sessions"), F.max("timestamp").alias("newest"))


@recipe
def thread_lifecycle(g: Graph, thread: str) -> DataFrame:
    e = g.edges.where((F.col("dst") == thread) & F.col("label").isin("SPAWNS", "CONTINUES", "RESOLVES"))
    ends = e.join(g.vertices.select(F.col("vid").alias("src"), "name", "session_id", "timestamp"), "src")
    return ends.select("label", F.coalesce("name", "session_id").alias("actor"), F.coalesce(_prop("closed_at"), F.col("timestamp").cast("string")).alias("at")).orderBy("at", "label")


@recipe
def agent_closes(g: Graph) -> DataFrame:
    return g.edges.where("label = 'RESOLVES' AND src_label = 'Agent'").select("src", "dst", _prop("basis").alias("basis"), _prop("approval_ref").alias("approval_ref"))


@recipe
def provenance_walk(g: Graph, node: str) -> DataFrame:
    return g.edges.where((F.col("src") == node) & (F.col("label") == "DERIVED_FROM")).join(g.vertices.select(F.col("vid").alias("dst"), "title", "uri", "tier"), "dst").select("dst", "title", "uri", "tier", _prop("anchors").alias("anchors"))


@recipe
def artifact_history(g: Graph, identifier: str) -> DataFrame:
    t = T(g).V().has_label("Artifact").has("identifier", containing(identifier)).as_("artifact").in_("TOUCHES")
    return t.df.groupBy(F.col("as_artifact").alias("artifact")).agg(F.array_sort(F.collect_set("value")).alias("touched_by"))


@recipe
def consultation_audit(g: Graph) -> DataFrame:
    cites = g.edges.where("label = 'REFERENCES'").where(_prop("role") == "citation").groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("n"))
    return g.vertices.where("label = 'Exchange'").join(cites, "vid", "left").select("vid", "status", F.coalesce("n", F.lit(0)).alias("citations"))


@recipe
def claim_convergence(g: Graph, least: int = 2) -> DataFrame:
    return g.edges.where("label = 'CONTAINS'").groupBy(F.col("dst").alias("claim")).agg(F.count_distinct("src").alias("sessions")).where(F.col("sessions") >= least)


@recipe
def evidence_heads(g: Graph) -> DataFrame:
    return T(g).V().has_label("Source").not_(lambda t: t.in_("SUPERSEDES")).df


@recipe
def paper_contribution(g: Graph, source: str) -> DataFrame:
    """Sessions whose retrievals returned a claim of the source."""
    return T(g).V(source).in_("DERIVED_FROM").has_label("Claim").as_("claim").in_("RETURNS").in_("QUERIES").select("claim").dedup().df


@recipe
def citation_weight(g: Graph) -> DataFrame:
    """How often each source's claims are cited by exchanges; counted in bulk along the hops."""
    t = T(g).V().has_label("Exchange").out_e("REFERENCES").has("role", eq("citation")).in_v().out("DERIVED_FROM").has_label("Source")
    return t.group_count("vid")


@recipe
def cold_sources(g: Graph) -> DataFrame:
    used = T(g).V().has_label("Trace").out("RETURNS").out("DERIVED_FROM").df.groupBy(F.col("value").alias("vid")).agg(F.sum("bulk").alias("n"))
    return g.vertices.where("label = 'Source'").join(used, "vid", "left").select("vid", F.coalesce("n", F.lit(0)).alias("returns")).orderBy("returns", "vid")


@recipe
def retrieval_audit(g: Graph) -> DataFrame:
    t = g.vertices.where("label = 'Trace'").select(F.col("vid").alias("src"), "injected_chars")
    r = g.edges.where("label = 'RETURNS'").join(t, "src")
    return r.groupBy(scope_of(F.col("dst")).alias("scope")).agg(F.count("*").alias("returns"), F.count_if(_prop("used") == "true").alias("used"), F.count_if(_prop("used") == "false").alias("ignored"))


@recipe
def tool_examples(g: Graph, scope: str) -> DataFrame:
    """Claims of a scope's sessions by kind."""
    return T(g).V().has_label("Session").has("scope", scope).out("CONTAINS").group_count("kind")
