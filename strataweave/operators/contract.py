"""Integrity checks: every rule is a filter or an anti join that yields (rule, subject, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import crosses_scope, scope_of
from ..functions.text import compound_tokens
from ..schema import EDGE_LABELS, VERTEX_LABELS

MIN_TERMS, MIN_RATIO = 2, 0.3


def _rule(rows: DataFrame, rule: str, subject: str | Column, detail: str | Column = "") -> DataFrame:
    text = detail if isinstance(detail, Column) else F.lit(detail)
    return rows.select(F.lit(rule).alias("rule"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject"), text.cast("string").alias("detail"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def check_vertices(v: DataFrame, *, tier_zero_is_hole: bool = False) -> DataFrame:
    """Unknown labels, holes in the provenance, external claims above tier 2, ids that disagree with their scope."""
    hole = F.col("tier").isNull() | _blank("source") | F.col("ingested_at").isNull()
    if tier_zero_is_hole:
        hole = hole | (F.col("tier") == 0)
    scoped = [k for k, (_, s) in VERTEX_LABELS.items() if s]
    bare = [k for k, (_, s) in VERTEX_LABELS.items() if not s]
    wrong = (F.col("label").isin(scoped) & (F.col("scope").isNull() | ~scope_of(F.col("vid")).eqNullSafe(F.col("scope")))) | (F.col("label").isin(bare) & (F.col("scope").isNotNull() | F.col("vid").startswith("scope:")))
    return _all([
        _rule(v.where(~F.col("label").isin(list(VERTEX_LABELS)) | F.col("label").isNull()), "vertex-label", "vid", F.coalesce("label", F.lit("none"))),
        _rule(v.where(hole), "provenance-hole", "vid"),
        _rule(v.where((F.col("label") == "Claim") & F.col("external") & (F.col("tier") < 2)), "laundered-claim", "vid", F.col("tier").cast("string")),
        _rule(v.where(wrong), "scope-integrity", "vid", F.coalesce("scope", F.lit("none"))),
    ])


def check_edges(e: DataFrame) -> DataFrame:
    """Unknown labels, wrong end labels, crossings that the label forbids, closes without grounds."""
    crossing = [k for k, (_, _, may) in EDGE_LABELS.items() if may]
    ends = F.lit(False)
    for label, (src, dst, _) in EDGE_LABELS.items():
        bad = F.lit(False)
        if src:
            bad = bad | ~F.coalesce(F.col("src_label").isin(list(src)), F.lit(False))
        if dst:
            bad = bad | ~F.coalesce(F.col("dst_label").isin(list(dst)), F.lit(False))
        ends = ends | ((F.col("label") == label) & bad)
    name = F.concat_ws(" ", "label", "src", "dst")
    prop = lambda k: F.coalesce(F.try_element_at("props", F.lit(k)), F.lit(""))
    return _all([
        _rule(e.where(~F.col("label").isin(list(EDGE_LABELS))), "edge-label", name),
        _rule(e.where(ends), "edge-ends", name, F.concat_ws(" -> ", "src_label", "dst_label")),
        _rule(e.where(~F.col("label").isin(crossing) & crosses_scope(F.col("src"), F.col("dst"))), "illegal-crossing", name),
        _rule(e.where((F.col("label") == "RESOLVES") & (F.col("src_label") == "Agent") & ((prop("basis") == "") | (prop("approval_ref") == ""))), "uncited-close", name),
    ])


def check_exchanges(v: DataFrame, e: DataFrame) -> DataFrame:
    """A closed set of states, and a citation for every answered exchange."""
    x = v.where("label = 'Exchange'")
    cited = e.where("label = 'REFERENCES'").where(F.try_element_at("props", F.lit("role")) == "citation").select(F.col("src").alias("vid")).distinct()
    return _all([
        _rule(x.where(~F.coalesce(F.col("status").isin("open", "answered"), F.lit(False))), "exchange-status", "vid", F.coalesce("status", F.lit("none"))),
        _rule(x.where("status = 'answered'").join(cited, "vid", "left_anti"), "answered-uncited", "vid"),
    ])


def check_orphans(v: DataFrame, e: DataFrame) -> DataFrame:
    """Vertices without an edge; an exchange that is still open may stand alone."""
    ends = e.select(F.col("src").alias("vid")).unionByName(e.select(F.col("dst").alias("vid"))).distinct()
    alone = v.join(ends, "vid", "left_anti").where(~((F.col("label") == "Exchange") & F.coalesce(F.col("status") == "open", F.lit(False))))
    return _rule(alone, "orphan", "vid", F.col("label"))


def check_evidence(v: DataFrame, blobs: DataFrame) -> DataFrame:
    """Sources without a hash or without retained bytes; ``blobs`` has hash."""
    s = v.where("label = 'Source'")
    lost = s.where(~_blank("content_hash")).join(blobs.select(F.col("hash").alias("content_hash")).distinct(), "content_hash", "left_anti")
    return _all([_rule(s.where(_blank("content_hash")), "source-hash", "vid"), _rule(lost, "evidence-lost", "vid", F.col("content_hash"))])


def uncited_blobs(v: DataFrame, blobs: DataFrame) -> DataFrame:
    return blobs.join(v.where("label = 'Source'").select(F.col("content_hash").alias("hash")).distinct(), "hash", "left_anti")


def check_graph(v: DataFrame, e: DataFrame, blobs: DataFrame | None = None, **options) -> DataFrame:
    parts = [check_vertices(v, **options), check_edges(e), check_exchanges(v, e), check_orphans(v, e)]
    return _all(parts if blobs is None else [*parts, check_evidence(v, blobs)])


def census(v: DataFrame, e: DataFrame) -> DataFrame:
    """(kind, label, n) of vertices and edges."""
    return v.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("vertex").alias("kind"), "label", "n").unionByName(e.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "label", "n"))


def check_sessions(sessions: DataFrame) -> DataFrame:
    """Session graphs with nested lists: artifacts that nothing references, undeclared references, empty provenance, no scope.

    Columns: session_id, scope, source, artifacts array<string>, referenced array<string>.
    """
    spare = sessions.select("session_id", F.explode(F.array_except("artifacts", "referenced")).alias("x"))
    unknown = sessions.select("session_id", F.explode(F.array_except("referenced", "artifacts")).alias("x"))
    return _all([
        _rule(spare, "unreferenced-artifact", "session_id", F.col("x")),
        _rule(unknown, "undeclared-artifact", "session_id", F.col("x")),
        _rule(sessions.where(_blank("source")), "empty-source", "session_id"),
        _rule(sessions.where(_blank("scope")), "missing-scope", "session_id"),
    ])


def prune_artifacts(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("artifacts", F.array_intersect("artifacts", "referenced"))


def check_knowledge(batches: DataFrame) -> DataFrame:
    """Knowledge batches: scope, origin, hash, claims, entities, chunks, anchors, kinds, tier.

    Columns: batch_id, scope, origin, content_hash, tier, entities array<string>,
    claims array<struct<kind, description, entities array<string>>>,
    chunks array<struct<ordinal int, text, start int, end int>>, anchors map<int,int>.
    """
    b = batches
    names = F.array_distinct(F.flatten(F.transform("claims", lambda c: F.coalesce(c["entities"], F.array().cast("array<string>")))))
    ordinals = F.transform("chunks", lambda c: c["ordinal"])
    each = lambda items: b.select("batch_id", F.explode(items).alias("x"))
    claim, chunk = each("claims"), each("chunks")
    anchors = b.select("batch_id", "claims", ordinals.alias("o"), F.explode("anchors").alias("k", "x")).where(~F.array_contains("o", F.col("x")) | (F.col("k") < 0) | (F.col("k") >= F.size("claims")))
    return _all([
        _rule(b.where("scope = 'main'"), "knowledge-in-main", "batch_id"),
        _rule(b.where(_blank("origin")), "missing-origin", "batch_id"),
        _rule(b.where(_blank("content_hash")), "missing-hash", "batch_id"),
        _rule(b.where("size(claims) <= 0"), "no-claims", "batch_id"),
        _rule(b.where("tier < 2 OR tier IS NULL"), "tier-too-trusted", "batch_id", F.coalesce(F.col("tier").cast("string"), F.lit("none"))),
        _rule(each(F.array_except("entities", names)), "orphan-entity", "batch_id", F.col("x")),
        _rule(each(F.array_except(names, "entities")), "undeclared-entity", "batch_id", F.col("x")),
        _rule(claim.where(~F.coalesce(F.col("x.kind"), F.lit("")).contains("/")), "bare-kind", "batch_id", F.col("x.kind")),
        _rule(claim.where(F.coalesce(F.trim("x.description"), F.lit("")) == ""), "empty-claim", "batch_id"),
        _rule(b.where(F.size(F.array_distinct(ordinals)) < F.size(ordinals)), "repeated-ordinal", "batch_id"),
        _rule(chunk.where(F.coalesce(F.trim("x.text"), F.lit("")) == ""), "empty-chunk", "batch_id", F.col("x.ordinal").cast("string")),
        _rule(chunk.where("x.end <= x.start"), "empty-span", "batch_id", F.col("x.ordinal").cast("string")),
        _rule(anchors, "dangling-anchor", "batch_id", F.concat_ws("->", F.col("k").cast("string"), F.col("x").cast("string"))),
    ])


def reconcile_entities(batches: DataFrame) -> DataFrame:
    """Narrow claims to declared entities and entities to used ones; nothing is added."""
    claims = F.transform("claims", lambda c: c.withField("entities", F.array_intersect(c["entities"], F.col("entities"))))
    out = batches.withColumn("claims", claims)
    return out.withColumn("entities", F.array_intersect("entities", F.array_distinct(F.flatten(F.transform("claims", lambda c: c["entities"])))))


#: External tokens up to which they are broadcast; they are counted first.
MOST_TOKENS = 200_000


def echoes(own: DataFrame, external: DataFrame, *, key: str, text: str, group: str | None = None, stop: tuple[str, ...] = ()) -> DataFrame:
    """(key, n, matched, echo): how many of a text's distinct compound terms the external texts (of its group) hold.

    An echo has min(terms, 2) of them and three tenths. Few external tokens are
    broadcast, so that the only rows shuffled are one count a text; more of them
    meet the terms in an equi-join.
    """
    by = [group] if group else []
    kept = F.filter(compound_tokens(F.col(text)), lambda t: (F.length(t) > 2) & ~t.isin(list(stop)) if stop else F.length(t) > 2)
    terms = own.select(key, *by, F.explode(kept).alias("tok"))
    tokens = external.select(*by, F.explode(compound_tokens(F.col("text"))).alias("tok")).distinct().withColumn("_in", F.lit(1))
    if tokens.limit(MOST_TOKENS + 1).count() <= MOST_TOKENS:
        tokens = F.broadcast(tokens)
    n = terms.join(tokens, [*by, "tok"], "left").groupBy(key).agg(F.count("*").alias("n"), F.count("_in").alias("matched"))
    return n.withColumn("echo", (F.col("matched") >= F.least("n", F.lit(MIN_TERMS))) & (F.col("matched") / F.col("n") >= MIN_RATIO))


def ingress_floor(claims: DataFrame, external: DataFrame, *, text: str = "description", group: str | None = "session", verifiable: bool = True, key: str = "claim_id", stop: tuple[str, ...] = (), counts: DataFrame | None = None) -> DataFrame:
    """Tier 2 for claims that are marked or echo the (session's) external texts; never a rise in trust.

    If the format cannot carry tool results, everything is floored. ``counts`` are
    the claims' ``echoes`` where the caller has them already.
    """
    reason = "transcript-ingress" if verifiable else "transcript-ingress-unverifiable"
    if not verifiable:
        hit = claims.withColumn("_echo", F.lit(True))
    else:
        found = echoes(claims, external, key=key, text=text, group=group, stop=stop) if counts is None else counts
        n = found.select(F.col(key).alias("_key"), F.col("echo").alias("_echo"))
        hit = claims.join(n, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("_echo", F.coalesce("_echo", F.lit(False)) | F.coalesce("external", F.lit(False)))
    origin = F.concat(F.lit("session:"), F.col(group) if group else F.lit(""), F.lit(f"#{reason}"))
    return hit.select(*[c for c in claims.columns if c not in ("tier", "external", "source")], F.when(F.col("_echo"), F.greatest("tier", F.lit(2))).otherwise(F.col("tier")).alias("tier"), (F.col("_echo") | F.coalesce("external", F.lit(False))).alias("external"), F.when(F.col("_echo"), origin).otherwise(F.col("source")).alias("source"))


def consultation_refusals(answers: DataFrame, v: DataFrame, e: DataFrame) -> DataFrame:
    """Answers (exchange, scope, answer, cited array<string>, recalls int): citations must exist in the consulted scope; single use; self-consultation needs a recall."""
    cited = answers.select("exchange", "scope", F.explode_outer("cited").alias("vid"))
    known = v.select("vid", F.col("scope").alias("found"))
    look = cited.join(known, "vid", "left")
    state = answers.join(v.where("label = 'Exchange'").select(F.col("vid").alias("exchange"), "status", "expert", "from_scope"), "exchange", "left")
    return _all([
        _rule(look.where("vid IS NULL"), "no-citation", "exchange"),
        _rule(look.where("vid IS NOT NULL AND found IS NULL"), "citation-unknown", "exchange", F.col("vid")),
        _rule(look.where("found <> scope"), "citation-elsewhere", "exchange", F.col("vid")),
        _rule(state.where("status IS NULL"), "exchange-unknown", "exchange"),
        _rule(state.where("status = 'answered'"), "already-answered", "exchange"),
        _rule(state.where("expert = from_scope AND coalesce(recalls, 0) < 1"), "no-fresh-recall", "exchange"),
    ])


def bare_rates(rates: DataFrame) -> DataFrame:
    """Rates (name, rate, low, reason) that carry neither an interval nor a reason."""
    return _rule(rates.where(F.col("rate").isNotNull() & F.col("low").isNull() & _blank("reason")), "bare-rate", "name")
