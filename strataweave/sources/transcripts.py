"""Agent transcripts as JSON lines: blocks, facts, usage, output windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import weighted_tokens
from .ledgers import parse_time, place, read_lines

CLAUDE = "type STRING, uuid STRING, timestamp STRING, cwd STRING, gitBranch STRING, isSidechain BOOLEAN, isMeta BOOLEAN, sessionId STRING, aiTitle STRING, message STRUCT<role: STRING, content: STRING, usage: STRUCT<input_tokens: BIGINT, cache_creation_input_tokens: BIGINT, cache_read_input_tokens: BIGINT, output_tokens: BIGINT>>"
CODEX = "timestamp STRING, type STRING, payload STRING"
CURSOR = "role STRING, type STRING, message STRUCT<content: STRING>"
_BLOCK = "ARRAY<STRUCT<type: STRING, text: STRING, id: STRING, name: STRING, input: STRING, tool_use_id: STRING, content: STRING>>"


def read_claude(spark: SparkSession, path: str) -> DataFrame:
    """Rows with the session named by the file; content stays text because it is a string or a list of blocks."""
    rows = read_lines(spark, path, CLAUDE)
    return rows.withColumns({"session": F.coalesce("sessionId", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)), "ts": parse_time(F.col("timestamp"))})


def largest_file(files: DataFrame) -> DataFrame:
    """The largest of a session's files; ``files`` has session, path, size."""
    return files.groupBy("session").agg(F.max_by("path", F.struct("size", "path")).alias("path"))


def own_rows(rows: DataFrame) -> DataFrame:
    """Without side chains and meta rows."""
    return rows.where("NOT coalesce(isSidechain, false) AND NOT coalesce(isMeta, false)")


def blocks(rows: DataFrame) -> DataFrame:
    """One row for each content block; a plain string is one text block."""
    content = F.col("message.content")
    listed = F.from_json(content, _BLOCK)
    plain = F.array(F.struct(*[F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("id", "name", "input", "tool_use_id", "content")]]))
    return rows.withColumn("block", F.explode(F.when(content.startswith("["), F.coalesce(listed, plain)).when(content.isNotNull(), plain)))


def is_scaffolding(text: Column) -> Column:
    """Tagged harness text, unless it is a command."""
    return text.startswith("<") & ~text.startswith("<command-name>")


def session_facts(rows: DataFrame) -> DataFrame:
    """Title, first cwd, last branch, time range, user turns, tool calls and first prompt of each session."""
    own = own_rows(rows)
    b = blocks(own)
    at = place()
    kind, text = F.col("block.type"), F.col("block.text")
    user = (F.col("type") == "user") & (kind == "text") & ~is_scaffolding(text)
    facts = own.groupBy("session").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), at)).alias("cwd"), F.max_by("gitBranch", F.when(F.col("gitBranch").isNotNull(), at)).alias("branch"), F.max_by("aiTitle", F.when(F.col("aiTitle").isNotNull(), at)).alias("title"))
    counts = b.groupBy("session").agg(F.count_if(user).alias("user_turns"), F.count_if(kind == "tool_use").alias("tool_calls"), F.min_by("block.text", F.when(user, at)).alias("prompt"))
    out = facts.join(counts, "session", "left").na.fill(0, ["user_turns", "tool_calls"])
    return out.withColumn("has_substance", (F.col("user_turns") > 0) & (F.col("prompt").isNotNull() | (F.col("tool_calls") > 0)))


def touched_files(rows: DataFrame) -> DataFrame:
    """(session, identifier, anchors): edited files with the distinct message ids in order; side chains excluded."""
    b = blocks(own_rows(rows)).where("block.type = 'tool_use'")
    path = F.coalesce(F.get_json_object("block.input", "$.file_path"), F.get_json_object("block.input", "$.notebook_path"), F.get_json_object("block.input", "$.path"))
    cwd = F.concat("cwd", F.lit("/"))
    named = b.withColumn("identifier", F.when(F.col("cwd").isNotNull() & path.startswith(cwd), F.substr(path, F.length(cwd) + 1)).otherwise(path)).where("identifier IS NOT NULL AND uuid IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("path", "line_no", "uuid")))
    return named.groupBy("session", "identifier").agg(F.array_distinct(F.transform(ordered, lambda x: x["uuid"])).alias("anchors"))


def call_results(rows: DataFrame) -> DataFrame:
    """Tool calls with their results by id; calls without one keep null, orphan results come last."""
    b = blocks(rows)
    calls = b.where("block.type = 'tool_use'").select("session", F.col("block.id").alias("call_id"), F.col("block.name").alias("tool"), F.col("block.input").alias("input"))
    results = b.where("block.type = 'tool_result'").select("session", F.col("block.tool_use_id").alias("call_id"), F.col("block.content").alias("result"))
    return calls.join(results, ["session", "call_id"], "full_outer")


def external_texts(rows: DataFrame, tools: tuple[str, ...] = ("WebFetch", "WebSearch")) -> DataFrame:
    return call_results(rows).where(F.col("tool").isin(list(tools)) & F.col("result").isNotNull()).select("session", F.col("result").alias("text"))


def usage(rows: DataFrame, since: str | None = None) -> DataFrame:
    """(session, ts, day, weight) of each API call that reports usage."""
    u = F.col("message.usage")
    calls = rows.where(u.isNotNull() & F.col("ts").isNotNull()).select("session", "path", "ts", F.to_date("ts").alias("day"), weighted_tokens(u["input_tokens"], u["cache_creation_input_tokens"], u["cache_read_input_tokens"], u["output_tokens"]).alias("weight"))
    return calls if since is None else calls.where(F.col("day") >= F.lit(since).cast("date"))


def output_window(rows: DataFrame, retrievals: DataFrame, turns: int | None = None) -> DataFrame:
    """Text of the assistant turns strictly after each retrieval, at most ``turns``; ``retrievals`` has trace_id, session, at."""
    b = blocks(own_rows(rows)).where("type = 'assistant' AND block.type IN ('text', 'tool_use')")
    said = b.groupBy("session", "ts", "path", "line_no").agg(F.array_join(F.collect_list(F.when(F.col("block.type") == "text", F.col("block.text")).otherwise(F.col("block.input"))), "\n").alias("text"))
    joined = retrievals.select("trace_id", "session", "at").join(said, "session").where("ts > at")
    if turns is not None:
        joined = joined.withColumn("_n", F.row_number().over(W.partitionBy("trace_id").orderBy("ts", "path", "line_no"))).where(F.col("_n") <= turns)
    whole = joined.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("ts", "path", "line_no", "text"))).alias("t"), F.count("*").alias("turns"))
    return whole.select("trace_id", "turns", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("output"))


def fork_delta(fork: DataFrame, parent: DataFrame) -> DataFrame:
    """Rows of the fork whose uuid the parent lacks, and rows without one."""
    named = fork.where("uuid IS NOT NULL").join(parent.select("uuid").where("uuid IS NOT NULL").distinct(), "uuid", "left_anti")
    return named.select(*fork.columns).unionByName(fork.where("uuid IS NULL"))


def codex_facts(rows: DataFrame) -> DataFrame:
    """Session id, cwd, time range, turns, tools and touched files of rollouts (timestamp, type, payload)."""
    p = lambda k: F.get_json_object("payload", f"$.{k}")
    sid = F.regexp_extract("path", r"([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})\.jsonl$", 1)
    at = parse_time(F.col("timestamp"))
    touched = F.map_keys(F.from_json(p("changes"), "MAP<STRING, STRING>"))
    return rows.withColumn("session", sid).groupBy("session").agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.min_by(p("cwd"), F.when(p("cwd").isNotNull(), place())).alias("cwd"), F.count_if((F.col("type") == "event_msg") & (p("type") == "user_message")).alias("user_turns"), F.count_if(p("type").isin("function_call", "custom_tool_call", "local_shell_call")).alias("tool_calls"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(touched)))).alias("touched"))


def cursor_facts(rows: DataFrame) -> DataFrame:
    """User turns, ended turns and unreadable lines of each file; rows are read with ``strict``."""
    return rows.groupBy("path").agg(F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("type") == "turn_ended").alias("ended"), F.count_if(F.col("_corrupt").isNotNull()).alias("unreadable"))


def digest_lines(rows: DataFrame, cap: int = 400) -> DataFrame:
    """(session, place, line): each block as one line with its role, clipped."""
    role = F.when(F.col("block.type") == "tool_use", "tool").when(F.col("block.type") == "tool_result", "result").otherwise(F.col("type"))
    body = F.coalesce("block.text", F.concat_ws(" ", "block.name", F.coalesce(F.get_json_object("block.input", "$.command"), F.get_json_object("block.input", "$.file_path"), F.col("block.input"))), "block.content")
    one = F.regexp_replace(body, r"\s*\n\s*", " ")
    return blocks(own_rows(rows)).where(~F.coalesce(is_scaffolding(F.col("block.text")), F.lit(False))).select("session", "path", "line_no", F.concat(F.lit("["), role, F.lit("] "), F.substring(one, 1, cap)).alias("line"))


def elide_middle(lines: DataFrame, *, budget: int, key: str = "session") -> DataFrame:
    """Head and tail lines within half the budget each; whole if all fit."""
    w = W.partitionBy(key).orderBy("path", "line_no")
    size = F.length("line") + 1
    marked = lines.withColumns({"_head": F.sum(size).over(w), "_tail": F.sum(size).over(W.partitionBy(key).orderBy(F.col("path").desc(), F.col("line_no").desc())), "_all": F.sum(size).over(W.partitionBy(key))})
    return marked.where((F.col("_all") <= budget) | (F.col("_head") <= budget / 2) | (F.col("_tail") <= budget / 2)).drop("_head", "_tail", "_all")
