"""Small set, ratio and roster operators of the readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def symmetric_difference(left: DataFrame, right: DataFrame, *, key: str) -> DataFrame:
    """(key, side): keys that only one side has; calls without a result, results without a call."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def is_prefix(shorter: Column, longer: Column) -> Column:
    """An ordered list begins with another one."""
    return F.slice(longer, 1, F.greatest(F.size(shorter), F.lit(0))).eqNullSafe(shorter)


def consistent_chain(lists: DataFrame, *, key: str, order: str, items: str) -> DataFrame:
    """(key, consistent): whether each list of a key begins with the one before it."""
    from pyspark.sql.window import Window as W

    before = F.lag(items).over(W.partitionBy(key).orderBy(order))
    return lists.withColumn("_ok", before.isNull() | is_prefix(before, F.col(items))).groupBy(key).agg(F.bool_and("_ok").alias("consistent"))


def has_substance(turns: Column, prompt: Column, tools: Column) -> Column:
    """A session worth keeping: it has turns, and a prompt or a tool call."""
    return (F.coalesce(turns, F.lit(0)) > 0) & ((F.coalesce(F.trim(prompt), F.lit("")) != "") | (F.coalesce(tools, F.lit(0)) > 0))


def import_policy(edges: DataFrame, *, depths: tuple[str, ...] = ("module",), kinds: tuple[str, ...] = ("import", "from")) -> DataFrame:
    """The import edges that the metrics count: of these depths and kinds."""
    return edges.where(F.col("depth").isin(list(depths)) & F.col("kind").isin(list(kinds)))


def proven_roots(rows: DataFrame, *, root: str, proof: str) -> DataFrame:
    """Roots that at least one row proves."""
    return rows.groupBy(root).agg(F.bool_or(F.coalesce(F.col(proof), F.lit(False))).alias("_p")).where("_p").select(root)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where the whole is zero or unknown."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def cache_hit_ratio(usage: DataFrame, *, group: str) -> DataFrame:
    """(group, ratio): cache reads among all input tokens; null where nothing was read in."""
    total = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("cache_creation_input_tokens", F.lit(0)) + F.coalesce("cache_read_input_tokens", F.lit(0))
    g = usage.groupBy(group).agg(F.sum(F.coalesce("cache_read_input_tokens", F.lit(0))).alias("_r"), F.sum(total).alias("_t"))
    return g.select(group, ratio(F.col("_r"), F.col("_t")).alias("ratio"))


def ticket_calls(events: DataFrame, ticket: str) -> DataFrame:
    """(n): calls of a delta that carried a ticket."""
    return events.where(F.col("ticket") == ticket).agg(F.count("*").alias("n"))


def active_first(rows: DataFrame, *, active: Column, at: str, limit: int | None = None) -> DataFrame:
    """Active rows first, each part newest first."""
    out = rows.orderBy(active.desc(), F.col(at).desc_nulls_last())
    return out if limit is None else out.limit(limit)


def merged_roster(first: DataFrame, second: DataFrame, *, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Union of two rosters by key, fields of the first before those of the second, sorted by scope or id and harness."""
    a, b = first.alias("a"), second.alias("b")
    out = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in columns])
    return out.orderBy(F.coalesce("scope", key) if "scope" in columns else F.col(key), *(["harness"] if "harness" in columns else []))


def scopes_of_session(vertices: DataFrame, session: str) -> DataFrame:
    """Scopes in which a session exists."""
    return vertices.where((F.col("label") == "Session") & (F.col("session_id") == session)).select("scope").distinct()


def summary_line(title: Column, prompt: Column, most: int = 180) -> Column:
    """Title and the opening prompt's first characters on one line."""
    head = F.substring(F.regexp_replace(F.coalesce(prompt, F.lit("")), "[ \\t\\r\\n]+", " "), 1, most)
    return F.concat_ws(" — ", F.when(F.trim(title) != "", F.trim(title)), F.when(F.trim(head) != "", F.trim(head)))


def capped_text(text: Column, *, lines: int, chars: int) -> Column:
    """A result cut to so many lines and then characters, with a mark where it was cut."""
    short = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    cut = F.substring(short, 1, chars)
    return F.when(cut == text, text).otherwise(F.concat(cut, F.lit("…")))


def call_summary(args: Column, keys: tuple[str, ...]) -> Column:
    """A tool call's first present argument, on one line."""
    return F.regexp_replace(F.coalesce(*[F.when(F.get_json_object(args, f"$.{k}") != "", F.get_json_object(args, f"$.{k}")) for k in keys], F.lit("")), "[ \\t\\r\\n]+", " ")


def protocol_hash(text: Column) -> Column:
    """Twelve hex digits that name a protocol's wording."""
    return F.substring(F.sha2(text, 256), 1, 12)


def descriptor_state(rows: DataFrame, now: Column, *, at: str, expires: str) -> DataFrame:
    """Adds age_s, between_turns and expired to live descriptors."""
    age = F.unix_seconds(now) - F.unix_seconds(at)
    return rows.withColumns({"age_s": age, "between_turns": F.coalesce(F.col("status") == "idle", F.lit(False)), "expired": F.coalesce(F.col(expires) <= now, F.lit(False))})


def window_ledger_join(windows: DataFrame, pins: DataFrame, *, fallback: DataFrame) -> DataFrame:
    """Windows (window, pane, ts) with the session that was launched in their pane, else the one of ``fallback`` (window, session_id)."""
    from ..sources.ledgers import last_wins, spawn_rows

    by_pane = last_wins(spawn_rows(pins), key="tmux_pane", value="session_id", where=F.coalesce("tmux_pane", F.lit("")) != "")
    a = windows.join(by_pane.select(F.col("tmux_pane").alias("pane"), F.col("session_id").alias("_a")), "pane", "left")
    return a.join(fallback.select("window", F.col("session_id").alias("_b")), "window", "left").select(*windows.columns, F.coalesce("_a", "_b").alias("session_id"), F.when(F.col("_a").isNotNull(), "pane").when(F.col("_b").isNotNull(), "time").alias("found_by"))


def check_manifests(manifests: DataFrame) -> DataFrame:
    """(rule, subject): manifests (name, scope, allow array<string>, kinds array<string>) that are in main, repeat a scope, allow nothing or declare a kind without a prefix."""
    def rule(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.lit(name).alias("rule"), F.col("name").alias("subject"))

    twice = manifests.groupBy("scope").agg(F.count("*").alias("_n")).where("_n > 1").select("scope")
    parts = [
        rule(manifests.where("scope = 'main' OR coalesce(scope, '') = ''"), "scope"),
        rule(manifests.join(twice, "scope", "left_semi"), "scope-twice"),
        rule(manifests.where("size(allow) <= 0"), "allows-nothing"),
        rule(manifests.where(F.exists("kinds", lambda k: ~F.contains(k, F.lit("/")))), "bare-kind"),
    ]
    return reduce(DataFrame.unionByName, parts)
