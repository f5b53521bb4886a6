"""The read endpoints over a graph: each is one plan, confined to the scopes that were granted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ranking as R
from ..operators.graph import fork_roots
from ..sources.store import Graph

MAIN = "main"


class Recall:
    """Endpoints for one caller; ``scopes`` is what the caller may see and no endpoint widens it."""

    def __init__(self, graph: Graph, scopes: Sequence[str] = (MAIN,)):
        self.scopes = list(scopes)
        self.v = graph.vertices.where(F.col("scope").isNull() | F.col("scope").isin(self.scopes))
        self.e = graph.edges

    def of(self, label: str) -> DataFrame:
        return self.v.where(F.col("label") == label)

    def edges(self, label: str) -> DataFrame:
        return self.e.where(F.col("label") == label)

    def _contained(self) -> DataFrame:
        """(session, claim) pairs."""
        return self.edges("CONTAINS").select(F.col("src").alias("session"), F.col("dst").alias("claim"))

    def keyword(self, query: str, limit: int = 5) -> DataFrame:
        """(kind, node, position, text, source_title) of sessions, claims without a session, and up to two chunks.

        A session scores for its summary and for every claim it contains.
        """
        words = X.keywords(query)
        if not words:
            recent = self.recent(limit).withColumn("position", F.lit(None).cast("long"))
            return recent.select(F.lit("session").alias("kind"), F.col("vid").alias("node"), "position", F.col("summary").alias("text"), F.lit(None).cast("string").alias("source_title"))
        hit = lambda rows, text, worth, node="vid": R.keyword_hits(rows, node=node, text=text, words=words, worth=worth)
        claims, contained = self.of("Claim"), self._contained()
        by_claim = hit(claims, "description", R.CLAIM_HIT).join(contained, F.col("node") == F.col("claim")).select(F.col("session").alias("node"), "keyword", "score")
        sessions = R.ranked(hit(self.of("Session"), "summary", R.SUMMARY_HIT).unionByName(by_claim.join(self.of("Session").select(F.col("vid").alias("node")), "node", "left_semi")), query=query, n_words=len(words))
        loose = claims.join(contained.select(F.col("claim").alias("vid")), "vid", "left_anti")
        knowledge = R.ranked(hit(loose, "description", R.KNOWLEDGE_HIT), query=query, n_words=len(words))
        window = R.mixed_window(sessions, knowledge, limit)
        chunks = R.top(R.ranked(hit(self.of("Chunk"), "text", R.CHUNK_HIT), query=query, n_words=len(words)), R.CHUNK_CAP).select(F.lit("chunk").alias("kind"), "node", F.lit(None).cast("long").alias("position"))
        named = window.unionByName(chunks).join(self.v.select(F.col("vid").alias("node"), F.coalesce("summary", "description", "text", "title").alias("text")), "node", "left")
        titles = self.edges("DERIVED_FROM").join(self.of("Source").select(F.col("vid").alias("dst"), "title"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("title").alias("source_title"))
        return named.join(titles, "node", "left").select("kind", "node", "position", "text", "source_title")

    def details(self, sessions: DataFrame, query: str) -> DataFrame:
        """Claims of sessions (node) that match the query, capped, with the stub that counts the rest."""
        rows = sessions.select(F.col("node").alias("session")).join(self._contained(), "session").join(self.of("Claim").select(F.col("vid").alias("claim"), "description"), "claim")
        return R.capped_details(rows, parent="session", text="description", order="claim", words=X.keywords(query))

    def spellings(self, identifier: str, cap: int = 25) -> DataFrame:
        """Artifacts whose identifier contains the text, and all that share a (repo, path) with one of them."""
        a = self.of("Artifact")
        hits = a.where(F.contains("identifier", F.lit(identifier)))
        keys = hits.where("coalesce(repo, '') <> '' AND coalesce(path, '') <> ''").select("repo", "path").distinct().orderBy("repo", "path").limit(cap)
        twins = a.join(keys, ["repo", "path"], "left_semi")
        return hits.select("vid").unionByName(twins.select("vid")).distinct()

    def by_artifact(self, identifier: str, limit: int = 5, *, include_direct: bool = False) -> DataFrame:
        """Newest sessions that contain a claim touching the artifact in any spelling; direct touches only on request."""
        touched = self.edges("TOUCHES").join(self.spellings(identifier).select(F.col("vid").alias("dst")), "dst", "left_semi").select(F.col("src").alias("claim"))
        sessions = self._contained().join(touched.distinct(), "claim").select(F.col("session").alias("vid"))
        if include_direct:
            sessions = sessions.unionByName(touched.select(F.col("claim").alias("vid")))
        return self.of("Session").join(sessions.distinct(), "vid", "left_semi").orderBy(F.col("timestamp").desc(), "vid").limit(limit)

    def by_project(self, project: str, limit: int = 5) -> DataFrame:
        return self.of("Session").where(F.contains("project", F.lit(project))).orderBy(F.col("timestamp").desc(), "vid").limit(limit)

    def recent(self, limit: int = 5) -> DataFrame:
        return self.of("Session").orderBy(F.col("timestamp").desc(), "vid").limit(limit)

    def open_threads(self, project: str = "", limit: int = 10, topic: str = "") -> DataFrame:
        rows = self.of("Thread").where(F.col("status").isin("open", "in_progress"))
        if project:
            rows = rows.where(F.contains("project", F.lit(project)))
        text = F.concat_ws(" ", "title", "description")
        return R.rerank(rows, base=[F.col("ingested_at").desc(), F.col("vid")], relevance=X.overlap(text, X.keywords(topic)), window=R.THREAD_WINDOW, limit=limit)

    def thread(self, thread_id: str) -> DataFrame:
        return self.of("Thread").where((F.col("thread_id") == thread_id) | (F.col("vid") == thread_id))

    def open_problems(self, project: str = "", limit: int = 10) -> DataFrame:
        """Unsolved problems by independent recurrence: how often asserted, by how many sessions once forks fall together, in which rooms."""
        problems = self.of("Claim").where("kind = 'problem'")
        unsolved = problems.join(self.edges("SOLVED_BY").select(F.col("src").alias("vid")).distinct(), "vid", "left_anti").select(F.col("vid").alias("claim"), "description")
        sessions = self.of("Session").select(F.col("vid").alias("session"), "session_id", "timestamp", "room", "forked_from", "project")
        if project:
            sessions = sessions.where(F.contains("project", F.lit(project)))
        seen = unsolved.join(self._contained(), "claim").join(sessions, "session")
        roots = fork_roots(seen.select("session_id", "forked_from").distinct(), node="session_id", parent="forked_from")
        out = seen.join(roots.withColumnRenamed("node", "session_id"), "session_id").groupBy("claim", "description").agg(F.count("*").alias("asserted"), F.count_distinct("root").alias("times"), F.max("timestamp").alias("last_seen"), F.array_sort(F.collect_set("room")).alias("rooms"))
        return out.orderBy(F.col("times").desc(), F.col("last_seen").desc(), "claim").limit(limit)

    def exchanges(self, query: str = "", limit: int = 5) -> DataFrame:
        """Exchanges that a granted scope took part in, relevance above recency among the newest fifty."""
        x = self.of("Exchange").where(F.col("expert").isin(self.scopes) | F.col("from_scope").isin(self.scopes))
        words = X.keywords(query)
        return R.rerank(x, base=[F.coalesce("answered_at", "ts").desc_nulls_last(), F.col("vid")], relevance=X.overlap(F.concat_ws(" ", "question", "answer"), words), window=R.EXCHANGE_WINDOW, limit=limit)

    def exchange(self, vid: str) -> DataFrame:
        """One exchange, or nothing to those who took no part in it."""
        return self.of("Exchange").where((F.col("vid") == vid) & (F.col("expert").isin(self.scopes) | F.col("from_scope").isin(self.scopes)))

    def consultations(self, limit: int = 5) -> DataFrame:
        """The newest exchanges that a granted scope took part in, with how many nodes each answer cites."""
        x = self.of("Exchange").where(F.col("expert").isin(self.scopes) | F.col("from_scope").isin(self.scopes))
        newest = x.orderBy(F.coalesce("answered_at", "ts").desc_nulls_last(), F.col("vid")).limit(limit)
        cited = self.edges("REFERENCES").where(F.try_element_at("props", F.lit("role")) == "citation").groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("citations"))
        out = newest.join(cited, "vid", "left").withColumn("citations", F.coalesce("citations", F.lit(0)))
        return out.orderBy(F.coalesce("answered_at", "ts").desc_nulls_last(), "vid")

    def exchange_by_ticket(self, ticket: str) -> DataFrame:
        """What a writer needs of one exchange, whatever its parties."""
        return self.of("Exchange").where((F.col("exchange_id") == ticket) | F.col("vid").endswith(f":exchange:{ticket}"))

    def known_claims(self, session: str) -> DataFrame:
        """Claims that a session holds already."""
        return self._contained().where(F.col("session") == session).join(self.of("Claim").select(F.col("vid").alias("claim"), "kind", "description"), "claim")

    def sessions_with_claims(self) -> DataFrame:
        """(session, claims): sessions that hold any."""
        return self._contained().groupBy("session").agg(F.count("*").alias("claims"))

    def brief(self, question: str, limit: int = 5) -> DataFrame:
        """(section, node) of what a consulted expert should see first; each node once, in its first section."""
        parts = [
            ("match", self.keyword(question, limit).select(F.col("node"))),
            ("thread", self.open_threads(limit=limit, topic=question).select(F.col("vid").alias("node"))),
            ("problem", self.open_problems(limit=limit).select(F.col("claim").alias("node"))),
            ("exchange", self.exchanges(question, limit).select(F.col("vid").alias("node"))),
        ]
        rows = None
        for k, (name, df) in enumerate(parts):
            part = df.select(F.lit(k).alias("k"), F.lit(name).alias("section"), "node")
            rows = part if rows is None else rows.unionByName(part)
        return rows.groupBy("node").agg(F.min_by("section", "k").alias("section"), F.min("k").alias("k")).orderBy("k", "node").select("section", "node")


def render(rows: DataFrame) -> DataFrame:
    """One markdown block for each recalled row; ids in backticks so that later readers find them."""
    text = X.quote_block(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit("- `"), F.col("node"), F.lit("` ("), F.col("kind"), F.lit(")"))
    return rows.select("node", F.concat_ws("\n", head, text, F.when(F.col("source_title").isNotNull(), F.concat(F.lit("from "), F.col("source_title")))).alias("block"))


def withhold(rows: DataFrame, *, rate: float, seed: str, node: str = "node") -> DataFrame:
    """Adds withheld: a seeded Bernoulli draw for each node, but never all of them; the least draw always stays.

    The set is one rendered response, so the one-row window is bounded by its limit.
    """
    from pyspark.sql.window import Window as W

    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.col(node)), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    marked = rows.withColumn("_d", draw)
    most = F.max("_d").over(W.partitionBy(F.lit(1)))
    return marked.withColumn("withheld", (F.col("_d") < rate) & (F.col("_d") < most)).drop("_d")
