"""What the endpoints write, as vertex and edge deltas for ``upsert_vertices`` and ``upsert_edges``.

A writer never touches storage: it yields the rows of one write, so that a write
is repeatable, can be checked before it lands and lands by an upsert.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I
from .ingest import edge

#: Lines of a ledger are one JSON object each, keys in order, nulls left out.
_JSON = {"ignoreNullFields": "true"}


def open_exchanges(requests: DataFrame, sessions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of consultations asked: requests (ticket, session, expert, from_scope, question, brief array<string>).

    The brief is what the expert is shown; each of its nodes is referenced once
    with the role ``brief``. A request of an unknown session opens an exchange
    that no session consults.
    """
    vid = I.vertex_id(F.lit("main"), "exchange", F.col("ticket"))
    v = requests.select(vid.alias("vid"), F.lit("Exchange").alias("label"), F.lit("main").alias("scope"), F.col("ticket").alias("exchange_id"), "expert", "from_scope", F.lit("open").alias("status"), "question", now.alias("ts"), F.lit(1).alias("tier"), F.concat(F.lit("session:"), "session").alias("source"), now.alias("ingested_at"))
    known = requests.join(sessions.select(F.col("vid").alias("session_vid"), F.col("session_id").alias("session")), "session")
    consults = edge(known, "CONSULTS", F.col("session_vid"), vid, "Session", "Exchange")
    shown = requests.select("*", F.explode(F.array_distinct("brief")).alias("node"))
    return v, consults.unionByName(edge(shown, "REFERENCES", vid, F.col("node"), "Exchange", "", F.create_map(F.lit("role"), F.lit("brief"))))


def close_exchanges(answers: DataFrame, exchanges: DataFrame, refused: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of answers (exchange, answer, cited array<string>, agent) to open exchanges; refused ones (subject) change nothing."""
    live = answers.join(exchanges.where("status = 'open'").select(F.col("vid").alias("exchange")), "exchange", "left_semi")
    live = live.join(refused.select(F.col("subject").alias("exchange")).distinct(), "exchange", "left_anti")
    v = live.select(F.col("exchange").alias("vid"), F.lit("answered").alias("status"), "answer", F.col("agent").alias("answered_from"), now.alias("answered_at"))
    cited = live.select("*", F.explode(F.array_distinct("cited")).alias("node"))
    return v, edge(cited, "REFERENCES", F.col("exchange"), F.col("node"), "Exchange", "", F.create_map(F.lit("role"), F.lit("citation")))


def close_threads(closes: DataFrame, threads: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, missing) of closes (thread, agent, status, basis, approval_ref) by an operator; threads that do not exist are ``missing``.

    The edge carries its grounds; a close without a basis or a reference is for
    ``check_edges`` to refuse, not for the writer to drop.
    """
    have = threads.where("label = 'Thread'").select(F.col("vid").alias("thread"))
    known = closes.join(have, "thread", "left_semi")
    v = known.groupBy(F.col("thread").alias("vid")).agg(F.max("status").alias("status"))
    held = F.map_filter(F.create_map(F.lit("basis"), F.col("basis"), F.lit("approval_ref"), F.col("approval_ref"), F.lit("closed_at"), now.cast("string")), lambda k, x: x.isNotNull())
    e = edge(known, "RESOLVES", F.concat(F.lit("agent:"), "agent"), F.col("thread"), "Agent", "Thread", held)
    return v, e, closes.join(have, "thread", "left_anti").select("thread").distinct()


def land_traces(traces: DataFrame, verdicts: DataFrame, sessions: DataFrame, nodes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): a Trace vertex for each trace, QUERIES from its session if that exists, RETURNS with the verdict to nodes that exist."""
    vid = I.vertex_id(F.coalesce("trace_scope", F.lit("main")), "trace", F.col("trace_id"))
    v = traces.select(vid.alias("vid"), F.lit("Trace").alias("label"), F.coalesce("trace_scope", F.lit("main")).alias("scope"), "session_id", "tool", "injected_chars", F.col("returned_count").cast("int").alias("returned_count"), "ts", F.lit(1).alias("tier"), F.concat(F.lit("tap:"), "trace_id").alias("source"), now.alias("ingested_at"))
    asked = traces.join(sessions.select(F.col("vid").alias("session_vid"), "session_id"), "session_id")
    named = verdicts.join(traces.select("trace_id", "trace_scope"), "trace_id").join(nodes.select(F.col("vid").alias("node"), F.col("label").alias("node_label")), "node")
    held = F.map_filter(F.create_map(F.lit("used"), F.col("used").cast("string")), lambda k, x: x.isNotNull())
    returns = edge(named, "RETURNS", vid, F.col("node"), "Trace", "", held).drop("dst_label")
    labels = named.select(F.col("node").alias("dst"), F.col("node_label").alias("dst_label")).distinct()
    return v, edge(asked, "QUERIES", F.col("session_vid"), vid, "Session", "Trace").unionByName(returns.join(labels, "dst").select("label", "src", "dst", "src_label", "dst_label", "props"))


def merged_with_record(record: DataFrame, model: DataFrame, *, key: str, identity: tuple[str, ...]) -> DataFrame:
    """Model output beside the deterministic record of the same key: the record wins on identity, the model adds what the record lacks."""
    a, b = record.alias("a"), model.alias("b")
    names = [c for c in dict.fromkeys([*record.columns, *model.columns]) if c != key]
    pick = []
    for c in names:
        x = F.col(f"a.{c}") if c in record.columns else F.lit(None)
        y = F.col(f"b.{c}") if c in model.columns else F.lit(None)
        pick.append((F.coalesce(x, y) if c in identity else F.coalesce(F.when(y.cast("string") != "", y), x) if c in model.columns else x).alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left").select(F.col(f"a.{key}").alias(key), *pick)


def ledger_lines(rows: DataFrame) -> DataFrame:
    """(value): each row as one JSON line."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), _JSON).alias("value"))


def append_lines(rows: DataFrame, folder: str) -> None:
    """Append rows to a ledger folder as new files; what is there is never rewritten, so readers and retries see whole files."""
    ledger_lines(rows).write.mode("append").text(folder)


def changed_only(rows: DataFrame, held: DataFrame, *, key: str, value: str) -> DataFrame:
    """Rows whose value differs from the last one held for their key; a key's first value counts as a change."""
    last = held.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return rows.join(last, F.col(key) == F.col("_k"), "left").where(~F.col("_v").eqNullSafe(F.col(value)) | F.col("_k").isNull()).drop("_k", "_v")


def new_blobs(blobs: DataFrame, held: DataFrame) -> DataFrame:
    """(hash, content) of contents that the archive lacks, each once, named by their SHA-256; held ones are never written again."""
    named = blobs.select(F.sha2("content", 256).alias("hash"), "content").dropDuplicates(["hash"])
    return named.join(held.select("hash").distinct(), "hash", "left_anti")


def withholding_records(draws: DataFrame) -> DataFrame:
    """Ledger rows of draws (session_id, scope, tool, ts, seed, rate, response, offered, withheld), keyed by the response's hash."""
    return draws.select(F.lit("1").alias("version"), "rate", "session_id", "scope", "tool", "ts", "seed", "offered", "withheld", F.sha2("response", 256).alias("response_sha256"))


def ingress_receipts(items: DataFrame) -> DataFrame:
    """(document, selected, discarded, selected_digest, discarded_digest) of items (document, place, text, selected): what was read and what was left."""
    def side(keep: bool) -> Column:
        listed = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("selected"), F.lit(False)) == keep, F.struct("place", "text"))))
        return F.array_join(F.transform(listed, lambda x: F.coalesce(x["text"], F.lit(""))), "\n")

    g = items.groupBy("document").agg(F.count_if("selected").alias("selected"), F.count_if(~F.coalesce(F.col("selected"), F.lit(False))).alias("discarded"), side(True).alias("_s"), side(False).alias("_d"))
    return g.select("document", "selected", "discarded", F.sha2("_s", 256).alias("selected_digest"), F.sha2("_d", 256).alias("discarded_digest"))
