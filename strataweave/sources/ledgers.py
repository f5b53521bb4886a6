"""Append-only JSON-lines ledgers as DataFrames, and the views that readers take of them.

``line_no`` is a row's place: file path, then byte-ordered line within the file.
Files are read by Spark as text and numbered within their file, so record order
is explicit and survives any partitioning. Bad lines stay as rows with
``_corrupt``; skipping or counting them is one filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..schema import LEDGERS

# The tools whose calls count as retrievals.
RETRIEVAL_TOOLS = (
    "memory_recall",
    "memory_recall_by_artifact",
    "memory_recall_by_project",
    "memory_recall_recent",
    "memory_open_threads",
    "memory_open_problems",
    "memory_thread",
    "memory_query",
    "memory_exchanges",
    "bash_gremlin",
)


def parse_time(text: Column) -> Column:
    """ISO time in either dialect, without a zone as UTC; null if it is none."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))


def read_lines(spark: SparkSession, path: str, ddl: str, *, strict: bool = False) -> DataFrame:
    """Rows of the ledger with ``path``, ``line_no`` and ``_corrupt``; blank lines go, bad lines too unless ``strict``."""
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"))
    lines = lines.where("trim(value) <> ''")
    # Ids rise along a file's blocks; a file is the unit of order, and monthly files are the unit of size.
    numbered = lines.withColumn("line_no", F.row_number().over(W.partitionBy("path").orderBy("_at")))
    full = F.from_json("value", f"{ddl}, `_corrupt` STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = numbered.select(full.alias("r"), "path", "line_no").select("r.*", "path", "line_no")
    return out if strict else out.where("_corrupt IS NULL").drop("_corrupt")


def ledger(spark: SparkSession, name: str, path: str, *, strict: bool = False) -> DataFrame:
    return read_lines(spark, path, LEDGERS[name], strict=strict)


def place() -> Column:
    return F.struct("path", "line_no")


def response_text(raw: Column) -> Column:
    """A tool response as text: text blocks joined by newlines, then a result envelope opened, anything else as it is."""
    blocks = F.from_json(raw, "ARRAY<STRUCT<type: STRING, text: STRING>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    text = F.when(raw.startswith("["), F.coalesce(joined, raw)).otherwise(raw)
    return F.when(F.ltrim(text).startswith("{"), F.coalesce(F.get_json_object(text, "$.result"), text)).otherwise(text)


def tap_events(traces: DataFrame, tools: tuple[str, ...] = RETRIEVAL_TOOLS) -> DataFrame:
    """Typed retrieval events: known tools with their server prefix stripped, a session and a time, ordered by time.

    Shell rows count only if they call the graph; what was only a marker goes.
    """
    tool = F.regexp_replace("tool_name", "^mcp__[^_]+(?:_[^_]+)*__", "")
    e = traces.withColumns({"tool": tool, "ts": parse_time(F.col("ts")), "response": response_text(F.col("tool_response"))})
    e = e.where(F.col("tool").isin(list(tools)) & F.col("ts").isNotNull() & F.col("session_id").isNotNull())
    command = F.coalesce(F.get_json_object("tool_input", "$.command"), F.lit(""))
    # Fixed value: what a shell command that opens the graph contains.
    calls = command.rlike(r"connect\(|with_remote\(|DriverRemoteConnection\(|Client\(|run_query\(|recall\(")
    e = e.where((F.col("tool") != "bash_gremlin") | calls)
    first = [F.get_json_object("tool_input", f"$.{k}") for k in ("query", "identifier", "project", "thread_id", "command")]
    asked = F.coalesce(*[F.when(x != "", x) for x in first])
    ids = X.returned_ids(F.col("response"))
    e = e.withColumns({"query_text": F.when(asked.isNotNull(), F.concat_ws(": ", "tool", asked)).otherwise(F.col("tool")), "returned": ids, "ticket": F.coalesce(F.get_json_object("tool_input", "$.ticket"), F.lit(""))})
    e = e.withColumns({"is_miss": X.is_miss(F.col("response")), "is_rejected": X.is_rejected(F.col("response"))})
    legacy = (F.col("tool") != "bash_gremlin") & (F.trim("response") != "") & ~F.col("is_miss") & ~F.col("is_rejected") & (F.size("returned") == 0)
    return e.withColumn("is_legacy", legacy).orderBy("ts", "path", "line_no")


def guard_events(guards: DataFrame, guard: str | None = None) -> DataFrame:
    """Guard verdicts with their default writer and fingerprints as arrays, in file order."""
    fp = F.filter(F.split(F.coalesce("fingerprint", F.lit("")), ","), lambda x: x != "")
    out = guards.withColumns({"ts": parse_time(F.col("ts")), "guard": F.coalesce(F.when(F.col("guard") != "", F.col("guard")), F.lit("terminal-step")), "fingerprint": fp}).where("ts IS NOT NULL AND coalesce(session_id, '') <> '' AND verdict IN ('block', 'pass')")
    return out if guard is None else out.where(F.col("guard") == guard)


def firings(conditioning: DataFrame) -> DataFrame:
    out = conditioning.withColumns({"ts": parse_time(F.col("ts")), "harness": F.coalesce("harness", F.lit("claude-code"))})
    return out.where("ts IS NOT NULL AND session_id IS NOT NULL AND class IS NOT NULL")


def spawn_rows(pins: DataFrame) -> DataFrame:
    return pins.where("session_id IS NOT NULL AND event IS NULL")


def last_wins(rows: DataFrame, *, key: str, value: str, where: Column | None = None) -> DataFrame:
    """(key, value) of the last row in file order."""
    rows = rows if where is None else rows.where(where)
    return rows.groupBy(key).agg(F.max_by(value, place()).alias(value))


def pin_scopes(pins: DataFrame) -> DataFrame:
    return last_wins(spawn_rows(pins), key="session_id", value="scope")


def pin_rooms(pins: DataFrame) -> DataFrame:
    return last_wins(spawn_rows(pins), key="session_id", value="room", where=F.coalesce("room", F.lit("")) != "")


def engaged(pins: DataFrame) -> DataFrame:
    return pins.where("event = 'engaged' AND session_id IS NOT NULL").select("session_id").distinct()


def launch_facts(pins: DataFrame, columns: tuple[str, ...] = ("scope", "agent", "room", "forked_from", "cwd", "entrypoint", "tmux_pane", "repo_root", "project")) -> DataFrame:
    """Each fact's last non-empty value of a session, in one aggregation."""
    pick = [F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.coalesce(F.col(c), F.lit("")) != "", place())).alias(c) for c in columns]
    return spawn_rows(pins).groupBy("session_id").agg(*pick)


def first_dated_scope(pins: DataFrame) -> DataFrame:
    """The scope of a session's earliest dated row; undated rows count only without a dated one."""
    at = parse_time(F.col("ts"))
    return spawn_rows(pins).groupBy("session_id").agg(F.min_by("scope", F.struct(at.isNull(), at, place())).alias("scope"))


def rankers(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", parse_time(F.col("ts"))).where("ts IS NOT NULL").orderBy("ts")


def ranker_changes(rows: DataFrame) -> DataFrame:
    """Only the rows at which the fingerprint changed; within months, so that no task holds a whole ledger."""
    month = F.date_trunc("month", "ts")
    w = W.partitionBy("_month").orderBy("ts")
    timed = rankers(rows).withColumn("_month", month)
    edge = timed.groupBy("_month").agg(F.max_by("fingerprint", "ts").alias("_end"))
    before = edge.select("_month", F.lag("_end").over(W.partitionBy(F.lit(1)).orderBy("_month")).alias("_before"))
    return timed.withColumn("_prev", F.lag("fingerprint").over(w)).join(before, "_month").where(~F.coalesce("_prev", "_before").eqNullSafe(F.col("fingerprint"))).select("ts", "fingerprint")


def withholdings(policy: DataFrame) -> DataFrame:
    """The last record for each response hash."""
    return policy.groupBy("response_sha256").agg(F.max_by(F.struct("version", "rate", "session_id", "scope", "tool", "ts", "seed", "offered", "withheld"), place()).alias("r")).select("response_sha256", "r.*")


def staged_queries(staged: DataFrame) -> DataFrame:
    """Each distinct query text once, its newest row, newest first."""
    one = staged.where("trim(query) <> ''").groupBy(F.trim("query").alias("text")).agg(F.max_by(F.struct("ts", "session_id", "scope", "surface", "query", "response_chars", "path", "line_no"), place()).alias("r"))
    return one.select("r.*").orderBy(F.col("path").desc(), F.col("line_no").desc())


def latest_kills(kills: DataFrame) -> DataFrame:
    return kills.groupBy("session").agg(F.max_by(F.struct("scope", "cwd", "project", "repo_root", "op", "at"), F.struct("at", "line_no")).alias("r")).select("session", "r.*")


def pending_closes(closes: DataFrame) -> DataFrame:
    """Proposals that nothing has approved or rejected yet."""
    return closes.where("event = 'proposed'").join(closes.where("event IN ('approved', 'rejected')").select("ref").distinct(), "ref", "left_anti")


def acknowledgements(rows: DataFrame) -> DataFrame:
    """(finding, reason): the last reason for each acknowledged finding."""
    return last_wins(rows.where("coalesce(finding, '') <> ''").withColumn("reason", F.coalesce("reason", F.lit("no reason given"))), key="finding", value="reason")


def unique_prefix(rows: DataFrame, prefix: str, *, key: str = "session_id") -> DataFrame:
    """One row: the only id with the prefix, or an error that says none or how many."""
    found = rows.where(F.col(key).startswith(prefix)).agg(F.count_distinct(key).alias("n"), F.min(key).alias("id"))
    return found.select(F.when(F.col("n") == 1, F.col("id")).alias(key), F.when(F.col("n") == 0, "no match").when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" matches"))).alias("error"))


def active_policies(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
