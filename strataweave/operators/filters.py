"""Predicates and small classifiers of the readers, as Column expressions and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import glob_regex

# Page shapes that hold an abstract and not the work.
ABSTRACT_PAGES = (r"^https?://arxiv\.org/abs/[^/?#]+/?$", r"^https?://pubmed\.ncbi\.nlm\.nih\.gov/\d+/?$", r"^https?://dl\.acm\.org/doi/(?!pdf/)[^?#]+$", r"^https?://ieeexplore\.ieee\.org/document/\d+/?$")


def host_allowed(url: Column, allow: list[str]) -> Column:
    """The url's host is an allowed one or below it."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    ok = F.lit(False)
    for h in allow:
        ok = ok | (host == h.lower()) | host.endswith("." + h.lower())
    return F.coalesce(ok, F.lit(False))


def is_abstract_page(url: Column) -> Column:
    ok = F.lit(False)
    for p in ABSTRACT_PAGES:
        ok = ok | url.rlike(p)
    return F.coalesce(ok, F.lit(False))


def path_verdict(path: Column, allow: list[str], deny: list[str], *, allow_first: bool = True) -> Column:
    """``allow`` or ``deny`` by the first list that matches; what no list names is denied if anything is allowed by name."""
    hit = lambda globs: F.coalesce(*[F.when(path.rlike(glob_regex(g)), F.lit(True)) for g in globs], F.lit(False))
    yes, no = hit(allow), hit(deny)
    rest = F.lit("deny" if allow else "allow")
    return F.when(yes, "allow").when(no, "deny").otherwise(rest) if allow_first else F.when(no, "deny").when(yes, "allow").otherwise(rest)


def in_window(rows: DataFrame, ts: str, since: Column | None, until: Column | None) -> tuple[DataFrame, DataFrame]:
    """(rows inside, one row of counts): undated rows and rows outside are left out and counted."""
    at = F.col(ts)
    ok = (F.lit(True) if since is None else at >= since) & (F.lit(True) if until is None else at <= until)
    counts = rows.agg(F.count_if(at.isNull()).alias("undated"), F.count_if(at.isNotNull() & ~ok).alias("outside"), F.count_if(at.isNotNull() & ok).alias("inside"))
    return rows.where(at.isNotNull() & ok), counts


def is_sandbox(project: Column) -> Column:
    return F.coalesce(project.startswith("-tmp-") | project.startswith("-private-tmp-") | project.contains("-scratch-"), F.lit(False))


def valid_items(items: DataFrame, *, group: str, pos: str, valid: Column, ref: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid items renumbered from 0 with their references remapped, dropped items with their place)."""
    marked = items.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    kept = marked.where("_ok").withColumn("_new", F.row_number().over(W.partitionBy(group).orderBy(pos)) - 1).drop("_ok")
    if ref is not None:
        names = kept.select(F.col(group).alias("_g"), F.col(pos).alias("_old"), F.col("_new").alias("_ref"))
        kept = kept.join(names, (F.col(group) == F.col("_g")) & (F.col(ref) == F.col("_old")), "left").drop(ref, "_g", "_old").withColumnRenamed("_ref", ref)
    return kept.drop(pos).withColumnRenamed("_new", pos), marked.where("NOT _ok").drop("_ok")


def is_framed(text: Column, url: Column) -> Column:
    """A fetched result that names the call's own url in its frame."""
    return F.startswith(text, F.concat(F.lit("# Content from "), url, F.lit("\n\n")))


def effective_tool(name: Column, args: Column, wrappers: list[str]) -> Column:
    """``server/tool`` behind a wrapper call, else the name itself."""
    inner = F.concat_ws("/", F.get_json_object(args, "$.server"), F.coalesce(F.get_json_object(args, "$.toolName"), F.get_json_object(args, "$.tool")))
    return F.when(name.isin(wrappers), inner).otherwise(name)


def not_dismissed(runs: DataFrame, dismissed: DataFrame, *, key: str = "session") -> DataFrame:
    """Sessions with more runs than when they were dismissed; ``runs`` has runs, ``dismissed`` has at_runs."""
    j = runs.join(dismissed.select(F.col(key).alias("_k"), "at_runs"), F.col(key) == F.col("_k"), "left")
    return j.where(F.col("runs") > F.coalesce("at_runs", F.lit(0))).drop("_k", "at_runs")


def run_class(text: Column, age_s: Column, *, stalled_s: int = 1200, abandoned_s: int = 3600) -> Column:
    """State of a run from its log: error, done, or by silence active, stalled, abandoned."""
    low = F.lower(text)
    return F.when(low.rlike("traceback|\\berror:"), "error").when(low.rlike("\\b(done|finished|wrote session)\\b"), "done").when(age_s >= abandoned_s, "abandoned").when(age_s >= stalled_s, "stalled").otherwise("active")


def latest_turn(rows: DataFrame, *, group: str, order: str, is_user: Column) -> DataFrame:
    """Rows after the last user turn of each group."""
    last = rows.groupBy(group).agg(F.max(F.when(is_user, F.col(order))).alias("_last"))
    return rows.join(last, group).where(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).drop("_last")


def envelope(lines: DataFrame, *, key: str, order: str, line: str) -> DataFrame:
    """(key, text, tokens): a model run's answer from its event lines; null without the terminal event."""
    kind = F.get_json_object(line, "$.type")
    item = F.get_json_object(line, "$.item.text")
    text = F.max_by(item, F.when((kind == "item.completed") & item.isNotNull(), F.col(order)))
    ended = F.bool_or(kind == "turn.completed")
    return lines.groupBy(key).agg(F.when(ended, text).alias("text"), F.max(F.get_json_object(line, "$.usage.output_tokens").cast("long")).alias("output_tokens"))


def sum_reported(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Sums where nothing reported stays null and never becomes zero."""
    return rows.groupBy(group).agg(*[F.sum(c).alias(c) for c in columns])


def tmux_windows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Typed rows of a tab-separated window list; the anchor is the lowest index of its session."""
    parts = F.split(line, "\t")
    rows = lines.where(F.size(parts) >= 3).select(parts[0].alias("session"), parts[1].try_cast("int").alias("index"), parts[2].alias("name")).where("index IS NOT NULL")
    return rows.withColumn("is_anchor", F.col("index") == F.min("index").over(W.partitionBy("session")))


def ledger_divergence(expected: DataFrame, recorded: DataFrame, *, key: str, columns: list[str]) -> DataFrame:
    """(key, column, expected, recorded) where they differ; nulls compare as values."""
    a, b = expected.alias("a"), recorded.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left")
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").cast("string").alias("expected"), F.col(f"b.{c}").cast("string").alias("recorded")) for c in columns])).alias("x")
    return j.select(F.col(f"a.{key}").alias(key), listed).select(key, "x.*").where("NOT (expected <=> recorded)")


def ticket_exchanges(events: DataFrame, exchanges: DataFrame) -> DataFrame:
    """(session_id, exchange) of calls that carried a ticket which names an exchange; dangling tickets go."""
    named = events.where("ticket <> ''").select("session_id", F.concat(F.lit("scope:main:exchange:"), "ticket").alias("exchange")).distinct()
    return named.join(exchanges.select(F.col("vid").alias("exchange")), "exchange", "left_semi")
