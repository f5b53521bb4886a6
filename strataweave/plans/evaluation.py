"""What recall is worth: taps to traces and verdicts, and the reports on use, cost, guards and conditioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import stats as S
from ..functions import text as X
from ..operators import joins as J
from ..sources import ledgers as L

MIN_TERMS, MIN_RATIO = 2, 0.3

# Tools that count as a follow-through of each class; null takes any.
EXPECTED_TOOLS = {
    "design": ["consult_request", "memory_recall", "memory_query"],
    "retrospect": ["memory_recall", "memory_recall_by_artifact", "memory_recall_by_project", "memory_recall_recent", "memory_thread", "memory_query"],
    "milestone": None,
    "falsify": ["memory_query", "bash_gremlin"],
}


def traces(events: DataFrame, rankers: DataFrame, *, scopes: DataFrame | None = None) -> DataFrame:
    """Tap events with trace_id, the ranker in force, priced length and shares; misses and rejections stay as classes."""
    e = events.withColumns({"trace_id": I.trace_id(F.col("session_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.col("tool"), F.col("tool_input")), "injected_chars": F.length("response").cast("long"), "returned_count": F.size("returned")})
    e = e.dropDuplicates(["trace_id"])
    e = J.as_of_join(e, L.rankers(rankers).select("ts", "fingerprint"), left_ts="ts", right_ts="ts", value="fingerprint", bucket="month", default="unknown").withColumnRenamed("fingerprint", "ranker_config")
    hint = I.scope_of(F.try_element_at("returned", F.lit(1)))
    if scopes is None:
        return e.withColumn("trace_scope", F.coalesce("scope", hint))
    # Candidates in order, each valid only if the session exists in that scope.
    tries = e.select("trace_id", "session_id", F.posexplode(F.array(F.col("scope"), hint, F.lit("main"))).alias("k", "candidate")).where("candidate IS NOT NULL")
    ok = tries.join(scopes.select("session_id", F.col("scope").alias("candidate")), ["session_id", "candidate"], "left_semi").groupBy("trace_id").agg(F.min_by("candidate", "k").alias("trace_scope"))
    return e.join(ok, "trace_id", "left")


def verdict(node: Column, content: Column, output: Column) -> tuple[Column, Column]:
    """(used, evidence) of one returned node against the later output."""
    low = F.lower(output)
    local = F.lower(F.element_at(F.split(node, ":"), -1))
    thread = node.rlike(":thread:[^:]*$") & (F.length(local) > 3) & (F.instr(low, local) > 0)
    terms, said = X.terms(content), X.tokens(output)
    matched = F.filter(terms, lambda t: F.array_contains(said, t))
    n, m = F.size(terms), F.size(matched)
    enough = (m >= F.least(n, F.lit(MIN_TERMS))) & (F.coalesce(F.try_divide(m, n), F.lit(0.0)) >= MIN_RATIO)
    listed = F.when(m > 0, F.array_join(F.slice(matched, 1, 6), ", ")).otherwise("none")
    used = F.when(F.instr(low, F.lower(node)) > 0, True).when(thread, True).when(n == 0, False).otherwise(enough)
    said_ = F.when(F.instr(low, F.lower(node)) > 0, "cited by vertex ID").when(thread, F.concat(F.lit("thread slug `"), local, F.lit("` referenced"))).when(n == 0, "no distinctive terms to match on").otherwise(F.concat(F.lit("matched "), m.cast("string"), F.lit("/"), n.cast("string"), F.lit(" terms: "), listed))
    return used, said_


def verdicts(traces_: DataFrame, nodes: DataFrame, outputs: DataFrame) -> DataFrame:
    """(trace_id, node, used, evidence): null where the session said nothing afterwards.

    ``nodes`` has vid and content, ``outputs`` trace_id and output. A trace's
    output is tokenised once, before its nodes are listed.
    """
    listed = traces_.select("trace_id", F.explode("returned").alias("node"))
    full = listed.join(nodes.select(F.col("vid").alias("node"), "content"), "node", "left").join(outputs.select("trace_id", "output"), "trace_id", "left")
    used, evidence = verdict(F.col("node"), F.coalesce("content", F.lit("")), F.col("output"))
    silent = F.coalesce(F.trim("output"), F.lit("")) == ""
    return full.select("trace_id", "node", F.when(~silent, used).alias("used"), F.when(silent, "no output after retrieval").otherwise(evidence).alias("evidence"))


def sync(graph_traces: DataFrame, traces_: DataFrame) -> DataFrame:
    """Traces not landed yet, by content id; running it again after landing yields nothing."""
    return traces_.join(graph_traces.select("trace_id"), "trace_id", "left_anti")


def sync_counts(traces_: DataFrame, verdicts_: DataFrame) -> DataFrame:
    """One row of outcome counters."""
    a = traces_.agg(F.count("*").alias("written"), F.count_if("is_miss").alias("misses"), F.count_if("is_rejected").alias("rejected"), F.count_if("is_legacy").alias("legacy"))
    b = verdicts_.agg(F.count("used").alias("attributed"), F.count_if("used").alias("used"), F.count_if(~F.col("used")).alias("ignored"), F.count_if(F.col("used").isNull()).alias("unjudged"))
    return a.join(b)


def shares(traces_: DataFrame, verdicts_: DataFrame) -> DataFrame:
    """Verdicts with an even share of their trace's price."""
    price = traces_.select("trace_id", "session_id", "tool", "ts", "trace_scope", "injected_chars", F.expr("injected_chars div nullif(returned_count, 0)").alias("share"))
    return verdicts_.join(price, "trace_id")


def use_report(traces_: DataFrame, verdicts_: DataFrame, *, by: tuple[str, ...] = ("trace_scope",), since: str | None = None, until: str | None = None) -> DataFrame:
    """Counts, prices and the use rate with its interval for each group; undated rows are left out of a window."""
    for bound, op in ((since, ">="), (until, "<=")):
        if bound:
            at = F.lit(bound).cast("timestamp")
            end = at + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND") if op == "<=" and len(bound) == 10 else at
            traces_ = traces_.where(F.col("ts") >= at if op == ">=" else F.col("ts") <= end)
    s = shares(traces_, verdicts_)
    t = traces_.groupBy(*by).agg(F.count("*").alias("traces"), F.count_distinct("session_id").alias("sessions"), F.count_if("is_miss").alias("misses"), F.sum("injected_chars").alias("injected_chars"))
    u = s.groupBy(*by).agg(F.count("*").alias("returns"), F.count("used").alias("attributed"), F.count_if("used").alias("used"), F.sum(F.when(F.col("used"), F.col("share"))).alias("used_chars"), F.sum(F.when(~F.col("used"), F.col("share"))).alias("ignored_chars"))
    low, high = S.wilson(F.col("used"), F.col("attributed"))
    return t.join(u, list(by), "left").withColumns({"use_rate": S.rate(F.col("used"), F.col("attributed")), "low": low, "high": high})


def most_ignored(traces_: DataFrame, verdicts_: DataFrame, top: int = 5) -> DataFrame:
    s = shares(traces_, verdicts_).where("used = false").groupBy("node").agg(F.sum("share").alias("wasted"), F.count("*").alias("ignored"))
    return s.orderBy(F.col("wasted").desc(), F.col("ignored").desc(), "node").limit(top)


def pin_report(traces_: DataFrame, verdicts_: DataFrame, pins: DataFrame) -> DataFrame:
    """Use by expert: pinned (the trace ran in the target's scope) and consulted, with engaged and idle sessions."""
    s = shares(traces_, verdicts_).withColumn("expert", I.scope_of(F.col("node")))
    role = F.when(F.col("trace_scope") == F.col("expert"), "pinned").otherwise("consulted")
    use = s.groupBy("expert", role.alias("role")).agg(F.count("*").alias("returns"), F.count("used").alias("attributed"), F.count_if("used").alias("used"), F.sum("share").alias("chars"))
    spawned, on = L.pin_scopes(pins), L.engaged(pins)
    traced = traces_.select("session_id").distinct().withColumn("_t", F.lit(True))
    state = spawned.join(on.withColumn("_e", F.lit(True)), "session_id", "left").join(traced, "session_id", "left").groupBy(F.col("scope").alias("expert")).agg(F.count_if(F.col("_e") & F.col("_t").isNull()).alias("engaged_without_trace"), F.count_if(F.col("_e").isNull() & F.col("_t").isNull()).alias("idle_spawns"))
    return use.join(state, "expert", "full_outer").withColumn("use_rate", S.rate(F.col("used"), F.col("attributed")))


def cost_buckets(usage: DataFrame, pins: DataFrame) -> DataFrame:
    """(day, bucket, sessions, calls, weight): interactive, extract, expert:<scope>, other."""
    scope = L.pin_scopes(pins)
    kind = F.when(F.col("path").contains("extract"), "extract").when(F.col("scope").isNull(), "other").when(F.col("scope") == "main", "interactive").otherwise(F.concat(F.lit("expert:"), "scope"))
    return usage.join(scope.withColumnRenamed("session_id", "session"), "session", "left").groupBy("day", kind.alias("bucket")).agg(F.count_distinct("session").alias("sessions"), F.count("*").alias("calls"), F.sum("weight").alias("weight"))


def occasion_burn(usage: DataFrame, pins: DataFrame, ceremonies: DataFrame) -> DataFrame:
    """(room, occasion, calls, weight): every call in the innermost occasion of its room that contains it, or in none."""
    calls = usage.join(L.pin_rooms(pins).withColumnRenamed("session_id", "session"), "session").withColumn("call", F.struct("session", "path", "ts", "weight"))
    calls = calls.withColumn("call_id", F.xxhash64("session", "path", "ts", F.monotonically_increasing_id()))
    starts = ceremonies.where("event = 'start'").select("room", "occasion_id", L.parse_time(F.coalesce("ts_start", "ts")).alias("s"))
    ends = L.last_wins(ceremonies.where("event = 'end'").withColumn("e", L.parse_time(F.coalesce("ts_end", "ts"))), key="occasion_id", value="e")
    spans = starts.join(ends, "occasion_id", "left")
    from ..operators.iterate import settle

    placed = J.interval_join(settle(calls.drop("call")), spans, key="room", at="ts", start="s", end="e", span_id="occasion_id", call_id=["call_id"])
    return placed.groupBy("room", "occasion_id").agg(F.count("*").alias("calls"), F.sum("weight").alias("weight"))


def guard_report(guards: DataFrame) -> DataFrame:
    """(blocks, passes, rescued, repeats) over the ledger in file order."""
    g = L.guard_events(guards, "terminal-step").withColumn("pos", F.struct("ts", "path", "line_no"))
    blocks, passes = g.where("verdict = 'block'"), g.where("verdict = 'pass' AND branch = 'terminal'")
    out = J.rescued(blocks.select("session_id", "pos", "fingerprint", "command_hash"), passes, key="session_id", pos="pos", prints="fingerprint")
    a = blocks.select("session_id", "pos", "command_hash", "fingerprint")
    same = a.join(a.select(F.col("session_id").alias("_s"), F.col("pos").alias("_p"), F.col("command_hash").alias("_h")), (F.col("session_id") == F.col("_s")) & (F.col("_p") > F.col("pos")) & (F.col("_h") == F.col("command_hash")) & (F.col("_h") != ""))
    alike = a.where("size(fingerprint) > 0").join(a.select(F.col("session_id").alias("_s"), F.col("pos").alias("_p"), F.col("fingerprint").alias("_f")), (F.col("session_id") == F.col("_s")) & (F.col("_p") > F.col("pos")) & (F.col("_f") == F.col("fingerprint")))
    repeats = same.select("session_id", "pos").unionByName(alike.select("session_id", "pos")).distinct().agg(F.count("*").alias("repeats"))
    return out.agg(F.count("*").alias("blocks"), F.count_if("rescued").alias("rescued")).join(passes.agg(F.count("*").alias("passes"))).join(repeats)


def query_classes(events: DataFrame, recipes: DataFrame | None = None) -> DataFrame:
    """(tool, arm, class, n) of ad-hoc queries; the order of the classes decides between them."""
    e = events.where(F.col("tool").isin("memory_query", "bash_gremlin"))
    r = F.trim("response")
    kind = F.when(F.col("is_miss"), "miss").when(r.contains("gremlin-python dialect"), "dialect").when(r.contains("mutating or side-effect"), "mutation").when(r.startswith("Query failed:"), "failed").when(F.col("is_rejected") | (r == ""), "errored").otherwise("ok")
    text = F.coalesce(F.get_json_object("tool_input", "$.query"), F.get_json_object("tool_input", "$.command"), F.lit(""))
    shape = F.concat(F.lit("|"), F.array_join(X.step_fingerprint(text), "|"), F.lit("|"))
    e = e.withColumns({"class": kind, "shape": shape})
    if recipes is None:
        return e.groupBy("tool", "class").agg(F.count("*").alias("n"))
    # Recipes (name, steps array, admitted) are a hand-kept list; its size is checked in the join.
    stored = recipes.where("size(steps) >= 2").select(F.concat(F.lit("|"), F.array_join("steps", "|"), F.lit("|")).alias("needle"), "admitted")
    hits = e.select("session_id", "ts", "tool", "shape", "class", "path", "line_no")
    found = J.contains_join(hits, stored, text="shape", name="needle").where("admitted IS NULL OR admitted <= ts").select("path", "line_no").distinct().withColumn("_r", F.lit(True))
    arm = F.when(F.col("_r"), "recipe-derived").otherwise("from-scratch")
    return hits.join(found, ["path", "line_no"], "left").groupBy("tool", arm.alias("arm"), "class").agg(F.count("*").alias("n"))


def conditioning_report(firings: DataFrame, events: DataFrame) -> DataFrame:
    """(class, harness, total, followed)."""
    calls = events.select("session_id", "ts", "tool", F.lit(None).cast("string").alias("class"), F.lit(None).cast("string").alias("harness"))
    fired = firings.select("session_id", "ts", F.lit(None).cast("string").alias("tool"), "class", "harness").where(F.col("class").isin(list(EXPECTED_TOOLS)))
    rows = J.followed_later(calls.unionByName(fired), key="session_id", at="ts", is_event=F.col("tool").isNotNull(), class_col="class", expected=EXPECTED_TOOLS, tool_col="tool")
    return rows.groupBy("class", "harness").agg(F.count("*").alias("total"), F.count_if("followed").alias("followed"))


def policy_draws(events: DataFrame, policy: DataFrame) -> DataFrame:
    """Events with the withholding draw whose response they carry."""
    return events.withColumn("response_sha256", F.sha2("response", 256)).join(L.withholdings(policy).select("response_sha256", "rate", "offered", "withheld"), "response_sha256", "left")


def daily_trend(traces_: DataFrame, verdicts_: DataFrame) -> DataFrame:
    s = shares(traces_, verdicts_)
    d = s.groupBy(F.to_date("ts").alias("day")).agg(F.count_if("used").alias("used"), F.count_if(~F.col("used")).alias("ignored"), F.sum(F.when(F.col("used"), F.col("share"))).alias("used_chars"), F.sum(F.when(~F.col("used"), F.col("share"))).alias("ignored_chars"))
    return d.withColumns({"used_pct": F.round(F.try_divide(100.0 * F.col("used"), F.col("used") + F.col("ignored")), 2), "waste_pct": F.round(F.try_divide(100.0 * F.col("ignored_chars"), F.coalesce("used_chars", F.lit(0)) + F.col("ignored_chars")), 2)})


def live_feed(events: DataFrame, guards: DataFrame, limit: int = 40) -> DataFrame:
    """The newest retrievals and guard verdicts together."""
    a = events.select("ts", "session_id", F.col("tool").alias("what"), F.when(F.size("returned") > 20, "fan-out").when(F.col("is_miss"), "miss").otherwise("ok").alias("state"), F.lit(False).alias("guardrail"))
    b = L.guard_events(guards).select("ts", "session_id", F.col("guard").alias("what"), F.col("verdict").alias("state"), F.lit(True).alias("guardrail"))
    return a.unionByName(b).orderBy(F.col("ts").desc(), "session_id", "what").limit(limit)


def today(events: DataFrame, now: Column) -> DataFrame:
    day = events.where(F.to_date("ts") == F.to_date(now))
    return day.agg(F.count("*").alias("retrievals"), F.coalesce(F.sum(F.expr("length(response) div 4")), F.lit(0)).alias("injected_tokens"), F.count_if("is_miss").alias("misses"), F.max_by("session_id", "ts").alias("current_session"))


def judge_grid(returned: DataFrame, judges: list[dict]) -> DataFrame:
    """Verdicts under several named judges in one plan; ``returned`` has trace_id, node, content, output.

    The judges are a fixed short list, exploded next to each row.
    """
    listed = F.explode(F.array(*[F.struct(F.lit(j["name"]).alias("name"), F.lit(int(j.get("terms", MIN_TERMS))).alias("terms"), F.lit(float(j.get("ratio", MIN_RATIO))).alias("ratio")) for j in judges]))
    terms, said = X.terms(F.col("content")), X.tokens(F.col("output"))
    rows = returned.withColumns({"_n": F.size(terms), "_m": F.size(F.array_intersect(terms, said))}).withColumn("j", listed)
    return rows.select("trace_id", "node", F.col("j.name").alias("judge"), ((F.col("_n") > 0) & (F.col("_m") >= F.least(F.col("_n"), F.col("j.terms"))) & (F.coalesce(F.try_divide("_m", "_n"), F.lit(0.0)) >= F.col("j.ratio"))).alias("used"))
