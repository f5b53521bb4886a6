"""Documents to graph deltas: chunks, anchors, entity mentions, knowledge batches, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import ids as I
from ..operators import joins as J
from ..sources.documents import chunked


def edge(rows: DataFrame, label: str, src: Column, dst: Column, src_label: str, dst_label: str, props: Column | None = None) -> DataFrame:
    empty = F.lit(None).cast("map<string,string>")
    return rows.select(F.lit(label).alias("label"), src.alias("src"), dst.alias("dst"), F.lit(src_label).alias("src_label"), F.lit(dst_label).alias("dst_label"), (empty if props is None else props).alias("props"))


def source_chunks(sources: DataFrame, **size) -> DataFrame:
    """Chunk vertices of ``sources`` (scope, content_hash, text): vid, ordinal, start, end, text, source."""
    keyed = sources.withColumn("source", I.vertex_id(F.col("scope"), "source", F.col("content_hash")))
    parts = chunked(keyed, doc_id="source", **size).join(keyed.select("source", "scope", "content_hash"), "source")
    return parts.withColumn("vid", I.vertex_id(F.col("scope"), "chunk", I.chunk_id(F.col("content_hash"), F.col("ordinal"))))


def chunk_edges(chunks: DataFrame) -> DataFrame:
    """DERIVED_FROM to the source, and ADJACENT_IN_TEXT from each chunk to the next."""
    after = F.lead("vid").over(W.partitionBy("source").orderBy("ordinal"))
    near = chunks.withColumn("_next", after).where("_next IS NOT NULL")
    return edge(chunks, "DERIVED_FROM", F.col("vid"), F.col("source"), "Chunk", "Source").unionByName(edge(near, "ADJACENT_IN_TEXT", F.col("vid"), F.col("_next"), "Chunk", "Chunk"))


def mentions(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """ABOUT edges of chunks whose text contains an entity's name."""
    hits = J.contains_join(chunks.select("vid", F.col("scope").alias("_scope"), F.col("text").alias("_body")), entities.select("name", "scope"), text="_body", name="name").where("_scope = scope")
    return edge(hits, "ABOUT", F.col("vid"), I.vertex_id(F.col("scope"), "entity", I.entity_id(F.col("name"))), "Chunk", "Entity")


def anchors(chunks: DataFrame, claims: DataFrame) -> DataFrame:
    """ANCHORS edges, with the span: the first chunk of a claim's source that holds its citation's first 60 characters."""
    asked = claims.where(F.length(F.trim("citation")) >= 24).select("claim", "source", F.lower(F.substring(F.trim("citation"), 1, 60)).alias("needle"))
    # Of a source's pairs of claims and chunks only those that hold the citation are ever made.
    held = J.contains_join(chunks.select("source", "vid", "ordinal", "start", "text"), asked.select("needle").distinct(), text="text", name="needle")
    hits = asked.join(held, ["source", "needle"])
    first = hits.groupBy("claim").agg(F.min_by(F.struct("vid", (F.col("start") + F.instr(F.lower("text"), F.col("needle")) - 1).alias("at"), F.length("needle").alias("n")), "ordinal").alias("h"))
    span = F.create_map(F.lit("start"), F.col("h.at").cast("string"), F.lit("end"), (F.col("h.at") + F.col("h.n")).cast("string"))
    return edge(first, "ANCHORS", F.col("claim"), F.col("h.vid"), "Claim", "Chunk", span)


def missing_chunks(sources: DataFrame, chunk_vertices: DataFrame, *, force: bool = False) -> DataFrame:
    """Sources that have no chunks yet, or all on request."""
    return sources if force else sources.join(chunk_vertices.select("source").distinct(), "source", "left_anti")


def knowledge_delta(batches: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of knowledge batches in the shape that ``check_knowledge`` takes, with title, uri and feed."""
    b = batches.withColumn("source_vid", I.vertex_id(F.col("scope"), "source", F.col("content_hash")))
    stamp = [F.col("tier").cast("int").alias("tier"), F.concat(F.lit("feed:"), F.coalesce("feed", F.lit(""))).alias("source"), now.alias("ingested_at")]
    sources = b.select(F.col("source_vid").alias("vid"), F.lit("Source").alias("label"), "scope", *stamp, F.lit("article").alias("kind"), "title", "uri", "origin", "content_hash", "feed")
    names = b.select("*", F.explode("entities").alias("name"))
    entity = I.vertex_id(F.col("scope"), "entity", I.entity_id(F.col("name")))
    entities = names.select(entity.alias("vid"), F.lit("Entity").alias("label"), "scope", *stamp, "name").dropDuplicates(["vid"])
    c = b.select("*", F.posexplode("claims").alias("pos", "c")).withColumn("claim", I.vertex_id(F.col("scope"), "claim", I.claim_id(F.col("c.kind"), F.col("c.description"))))
    claims = c.select(F.col("claim").alias("vid"), F.lit("Claim").alias("label"), "scope", *stamp, F.col("c.kind").alias("kind"), F.col("c.description").alias("description"), F.lit(True).alias("external")).dropDuplicates(["vid"])
    k = b.select("*", F.explode("chunks").alias("k")).withColumn("chunk", I.vertex_id(F.col("scope"), "chunk", I.chunk_id(F.col("content_hash"), F.col("k.ordinal"))))
    chunks = k.select(F.col("chunk").alias("vid"), F.lit("Chunk").alias("label"), "scope", *stamp, F.col("k.text").alias("text"), F.col("k.ordinal").alias("ordinal"), F.col("k.start").alias("start"), F.col("k.end").alias("end"))
    vertices = sources.unionByName(entities, True).unionByName(claims, True).unionByName(chunks, True)
    about = c.select("*", F.explode("c.entities").alias("name"))
    linked = c.select("claim", "scope", "content_hash", "pos", F.explode("anchors").alias("a", "ordinal")).where("a = pos")
    edges = (
        edge(c, "DERIVED_FROM", F.col("claim"), F.col("source_vid"), "Claim", "Source")
        .unionByName(edge(about, "ABOUT", F.col("claim"), entity, "Claim", "Entity"))
        .unionByName(edge(linked, "ANCHORS", F.col("claim"), I.vertex_id(F.col("scope"), "chunk", I.chunk_id(F.col("content_hash"), F.col("ordinal"))), "Claim", "Chunk"))
        .unionByName(chunk_edges(k.select(F.col("chunk").alias("vid"), F.col("source_vid").alias("source"), F.col("k.ordinal").alias("ordinal"))))
    )
    return vertices, edges


def superseded(old_sources: DataFrame, new_sources: DataFrame) -> DataFrame:
    """SUPERSEDES edges from a new source to the current head with the same origin and other bytes."""
    heads = old_sources.where("coalesce(origin, '') <> ''").groupBy("scope", "origin").agg(F.max_by(F.struct("vid", "content_hash"), F.struct("ingested_at", "vid")).alias("h"))
    j = new_sources.join(heads, ["scope", "origin"]).where("h.content_hash <> content_hash")
    return edge(j, "SUPERSEDES", F.col("vid"), F.col("h.vid"), "Source", "Source")


def session_delta(facts: DataFrame, touched: DataFrame, *, scope: str, tool: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) that a transcript proves by itself: the session, its artifacts, what it touched."""
    vid = I.vertex_id(F.lit(scope), "session", F.col("session"))
    stamp = [F.lit(1).alias("tier"), F.concat(F.lit("session:"), "session").alias("source"), now.alias("ingested_at")]
    good = facts.where("has_substance")
    text = F.concat_ws(" — ", "title", F.substring("prompt", 1, 180))
    sessions = good.select(vid.alias("vid"), F.lit("Session").alias("label"), F.lit(scope).alias("scope"), *stamp, F.col("session").alias("session_id"), F.col("started_at").alias("timestamp"), F.lit(tool).alias("tool"), "cwd", text.alias("summary"))
    t = touched.join(good.select("session"), "session", "left_semi")
    artifacts = t.select(F.concat(F.lit("artifact:"), "identifier").alias("vid"), F.lit("Artifact").alias("label"), F.lit(None).cast("string").alias("scope"), *stamp, "identifier", F.lit("file").alias("type")).dropDuplicates(["vid"])
    props = F.create_map(F.lit("anchors"), F.array_join("anchors", ","))
    return sessions.unionByName(artifacts, True), edge(t, "TOUCHES", vid, F.concat(F.lit("artifact:"), "identifier"), "Session", "Artifact", props)


def projections(artifacts: DataFrame, checkouts: DataFrame) -> DataFrame:
    """(identifier, repo, path): the longest checkout that is a prefix of an absolute identifier, and the rest."""
    hit = J.longest_affix(artifacts.select("identifier"), checkouts.select(F.col("repo_root").alias("repo")), path="identifier", affix="repo", row_id="identifier")
    return hit.select("identifier", "repo", F.substr("identifier", F.length("repo") + 2).alias("path"))


def merged_extractions(parts: DataFrame) -> DataFrame:
    """(document, title, claims, entities) of parts (document, part, title, claims, entities): claims in order, entities first-wins by name."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "claims")))
    claims = parts.groupBy("document").agg(F.flatten(F.transform(ordered, lambda x: x["claims"])).alias("claims"), F.min_by("title", F.when(F.coalesce("title", F.lit("")) != "", F.col("part"))).alias("title"))
    named = parts.select("document", "part", F.explode("entities").alias("e")).groupBy("document", F.col("e.name").alias("name")).agg(F.min_by("e", "part").alias("e"))
    entities = named.groupBy("document").agg(F.array_sort(F.collect_list("e")).alias("entities"))
    return claims.join(entities, "document", "left")
