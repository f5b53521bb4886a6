"""Queries over filters, chunking and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import filters as FL
from ..operators.iterate import shared_folder
from ..sources.documents import chunked
from ..streaming import ledgers as ST
from .registry import Tables, query


@query()
def chunker(t):
    """Overlapping chunks of every document with their places."""
    return chunked(t.documents.select("doc_id", "text")).select("doc_id", "ordinal", "start", "end", F.sha2("text", 256).alias("text_sha256"))


def _stream(t: Tables, build, name: str):
    """Drain the events table as a stream into a table of the shared folder, and read that."""
    spark = t.spark
    source = spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder).withColumn("at", F.col("ts").cast("timestamp"))
    base = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    result = build(source)
    q = result.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/rows")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/rows")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(t):
    out = _stream(t, lambda s: ST.tumbling(s, "event_type"), "tumbling")
    return out.select(F.unix_micros("start").alias("start"), "event_type", "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 43200000000 THEN 0 ELSE 1 END AS fresh FROM events),
     s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, sid
""")
def stream_session(t):
    out = _stream(t, lambda s: ST.sessions(s, "user_id", gap="12 hours"), "session")
    return out.select("user_id", F.unix_micros("start").alias("start"), "n")


@query("SELECT event_type AS kind, max(event_id) AS last_id FROM events GROUP BY 1")
def stream_last_rows(t):
    return _stream(t, lambda s: ST.last_rows(s, key="event_type", value="event_id", order="event_id"), "last").select(F.col("event_type").alias("kind"), F.col("event_id").alias("last_id"))


@query("""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host = 'example.com' OR host LIKE '%.example.com' AS allowed,
  CASE WHEN regexp_matches(path, '^/en/.*[.]html$') THEN 'allow' WHEN regexp_matches(path, '^/en/.*$') THEN 'deny' ELSE 'deny' END AS verdict
FROM h
""")
def boundary_filters(t):
    """Host suffixes, and globs of which the allow list is read first."""
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    return t.pages.select("page_id", FL.host_allowed(F.col("url"), ["example.com"]).alias("allowed"), FL.path_verdict(path, ["/en/*.html"], ["/en/*"]).alias("verdict"))


@query("""
WITH k AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations WHERE role <> 'system' AND length(text) > 40),
     r AS (SELECT conv_id, turn, turn - 1 AS answers FROM k)
SELECT k.conv_id, CAST(k.position AS INTEGER) AS turn, CAST(p.position AS INTEGER) AS answers FROM k JOIN r ON k.conv_id = r.conv_id AND k.turn = r.turn LEFT JOIN k p ON p.conv_id = k.conv_id AND p.turn = r.answers
""")
def renumbered_items(t):
    """Invalid items drop one by one; the rest are renumbered and their references follow."""
    items = t.conversations.withColumn("answers", F.col("turn") - 1)
    kept, _ = FL.valid_items(items, group="conv_id", pos="turn", valid=(F.col("role") != "system") & (F.length("text") > 40), ref="answers")
    return kept.select("conv_id", F.col("turn").cast("int").alias("turn"), F.col("answers").cast("int").alias("answers"))


@query("SELECT conv_id, turn FROM conversations c WHERE turn > coalesce((SELECT max(turn) FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'user'), -1)")
def latest_turn(t):
    return FL.latest_turn(t.conversations.select("conv_id", "turn", "role"), group="conv_id", order="turn", is_user=F.col("role") == "user").select("conv_id", "turn")


@query("SELECT count(*) FILTER (ts IS NULL) AS undated, count(*) FILTER (ts < TIMESTAMP '2024-01-05' OR ts > TIMESTAMP '2024-01-20') AS outside, count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') AS inside FROM events")
def window_counts(t):
    bound = lambda x: F.lit(x).cast("timestamp_ntz")
    return FL.in_window(t.events, "ts", bound("2024-01-05"), bound("2024-01-20"))[1]
