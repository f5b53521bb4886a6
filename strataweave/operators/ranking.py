"""Scoring, floors, reproducible ties, mixed windows and caps of the recall results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# What a hit is worth, and how wide results may be.
SUMMARY_HIT = 2.0
CLAIM_HIT = 1.0
KNOWLEDGE_HIT = 2.0
CHUNK_HIT = 1.0
MATCH_FLOOR = 2
DETAIL_CAP = 8
WINDOW_DIVISOR = 2
CHUNK_CAP = 2
EXCHANGE_WINDOW = 50
THREAD_WINDOW = 400


def tie_break(query: str, node: Column) -> Column:
    """A hash of query and node: stable, and no node wins every query."""
    return F.sha2(F.concat(F.lit(query), F.char(F.lit(0)), node), 256)


def keyword_hits(rows: DataFrame, *, node: str, text: str, words: list[str], worth: float) -> DataFrame:
    """(node, keyword, score): one row for each keyword that a row's text contains.

    The text is lower-cased once and tested against all words in the scan.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.filter(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words]), lambda w: w.isNotNull())
    return rows.select(F.col(node).alias("node"), F.explode(found).alias("keyword")).withColumn("score", F.lit(worth))


def ranked(hits: DataFrame, *, query: str, n_words: int, floor: int = MATCH_FLOOR) -> DataFrame:
    """(node, score, matched) of nodes that hit min(floor, n_words) distinct keywords or more."""
    total = hits.groupBy("node").agg(F.sum("score").alias("score"), F.count_distinct("keyword").alias("matched"))
    return total.where(F.col("matched") >= min(floor, n_words)).withColumn("tie", tie_break(query, F.col("node")))


def by_rank() -> list[Column]:
    return [F.col("score").desc(), F.col("tie"), F.col("node")]


def top(ranked_: DataFrame, limit: int) -> DataFrame:
    return ranked_.orderBy(*by_rank()).limit(limit)


def mixed_window(sessions: DataFrame, knowledge: DataFrame, limit: int) -> DataFrame:
    """(kind, node, position): knowledge holds up to half the window if sessions matched, sessions fill, knowledge fills what is left.

    Only ``limit`` rows of each ranking can take part, so both are cut by a
    top-k before they are numbered.
    """
    number = W.partitionBy("kind").orderBy(*by_rank())
    both = top(sessions, limit).withColumn("kind", F.lit("session")).unionByName(top(knowledge, limit).withColumn("kind", F.lit("claim")))
    both = both.withColumn("rank", F.row_number().over(number))
    all_ = W.partitionBy(F.lit(1))
    n_sessions = F.count_if(F.col("kind") == "session").over(all_)
    n_claims = F.count_if(F.col("kind") == "claim").over(all_)
    reserved = F.when(n_sessions > 0, F.least(n_claims, F.lit(limit // WINDOW_DIVISOR))).otherwise(n_claims)
    both = both.withColumns({"reserved": reserved, "n_sessions": n_sessions})
    sessions_in = F.least(F.col("n_sessions"), F.lit(limit) - F.col("reserved"))
    place = F.when((F.col("kind") == "claim") & (F.col("rank") <= F.col("reserved")), F.col("rank")).when(F.col("kind") == "session", F.when(F.col("rank") <= sessions_in, F.col("reserved") + F.col("rank"))).otherwise(F.col("rank") + sessions_in)
    return both.withColumn("position", place).where(F.col("position") <= limit).select("kind", "node", F.col("position").cast("long"))


def capped_details(details: DataFrame, *, parent: str, text: str, order: str, words: list[str], cap: int = DETAIL_CAP) -> DataFrame:
    """(parent, position, detail): the first ``cap`` matching details of each parent, then a stub that counts the two kinds left out.

    Without words the first ``cap`` details stand and nothing is counted.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    match = F.lit(not words)
    for w in words:
        match = match | F.contains(low, F.lit(w))
    marked = details.withColumn("_match", match)
    position = F.row_number().over(W.partitionBy(parent, "_match").orderBy(order))
    shown = marked.withColumn("position", position).where((F.col("position") <= cap) & F.col("_match")).select(parent, F.col("position").cast("long"), F.col(text).alias("detail"))
    if not words:
        return shown
    counts = marked.groupBy(parent).agg(F.count_if("_match").alias("m"), F.count_if(~F.col("_match")).alias("u"))
    capped = F.greatest(F.col("m") - cap, F.lit(0))
    parts = F.concat_ws("; ", F.when(capped > 0, F.format_string(f"%d matched but exceeded the {cap}-claim render cap", capped)), F.when(F.col("u") > 0, F.format_string("%d did not match the query", F.col("u"))))
    stub = counts.where((capped > 0) | (F.col("u") > 0)).select(parent, (F.least("m", F.lit(cap)) + 1).cast("long").alias("position"), F.concat(F.format_string("%d more claim(s) in this session: ", capped + F.col("u")), parts, F.lit(" — recall the session node to expand")).alias("detail"))
    return shown.unionByName(stub)


def rerank(rows: DataFrame, *, base: list[Column], relevance: Column, window: int, limit: int) -> DataFrame:
    """A wide read in base order, then by relevance with ties in base order, then the cut."""
    wide = rows.orderBy(*base).limit(window).withColumn("overlap", relevance)
    return wide.orderBy(F.col("overlap").desc(), *base).limit(limit)


def running_cap(rows: DataFrame, *, order: list[Column], size: Column, max_rows: int, max_size: int) -> DataFrame:
    """Rows in order until the row cap or the running size is reached; only ``max_rows`` rows are ever numbered."""
    few = rows.orderBy(*order).limit(max_rows).withColumn("_size", size)
    w = W.partitionBy(F.lit(1)).orderBy(*order)
    return few.withColumn("_run", F.sum("_size").over(w)).where(F.col("_run") <= max_size).drop("_run", "_size")
