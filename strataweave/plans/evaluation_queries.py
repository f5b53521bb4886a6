"""Evaluation reports, ledger views and ceremony audits over the events table, called as they are.

An event is a retrieval: its user the session, its kind the tool, its value the
injected size in cents, its number k the verdict's evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import ledgers as L
from . import ceremonies as CE
from . import evaluation as EV
from .memory_graph import k
from .registry import Tables, query

_EV = """WITH ev AS (SELECT event_id, user_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
  tr AS (SELECT *, 'exp' || (user_id % 4) AS scope, k % 4 AS nodes FROM ev),
  vd AS (SELECT event_id, user_id, event_type, ts, scope, cents, n, 'scope:exp' || n || ':claim:' || (event_id % 50) AS node, CASE WHEN nodes > 0 THEN cents // nodes END AS share, CASE WHEN k % 9 <> 0 THEN k + n >= 50 END AS used FROM (SELECT *, unnest(range(0, nodes)) AS n FROM tr)) """


def _traces(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), k().alias("k"), F.round(F.col("value") * 100).cast("long").alias("injected_chars"))
    return e.select(
        F.col("event_id").cast("string").alias("trace_id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("tool"), "ts", F.concat(F.lit("exp"), (F.col("user_id") % 4).cast("string")).alias("trace_scope"),
        "injected_chars", (F.col("k") % 4).alias("returned_count"), (F.col("k") % 4 == 0).alias("is_miss"), (F.col("k") % 7 == 0).alias("is_rejected"), (F.col("k") % 11 == 0).alias("is_legacy"), "k",
    )


def _verdicts(t: Tables) -> DataFrame:
    rows = _traces(t).where("returned_count > 0").withColumn("n", F.explode(F.sequence(F.lit(0), F.col("returned_count") - 1)))
    node = F.concat(F.lit("scope:exp"), F.col("n").cast("string"), F.lit(":claim:"), (F.col("trace_id").cast("long") % 50).cast("string"))
    return rows.select("trace_id", node.alias("node"), F.when(F.col("k") % 9 != 0, F.col("k") + F.col("n") >= 50).alias("used"))


@query(f"""{_EV}, a AS (SELECT scope AS trace_scope, count(*) AS traces, count(DISTINCT user_id) AS sessions, count(*) FILTER (nodes = 0) AS misses, CAST(sum(cents) AS BIGINT) AS injected_chars FROM tr GROUP BY 1),
  b AS (SELECT scope AS trace_scope, count(*) AS returns, count(used) AS attributed, count(*) FILTER (used) AS used, CAST(sum(CASE WHEN used THEN share END) AS BIGINT) AS used_chars, CAST(sum(CASE WHEN NOT used THEN share END) AS BIGINT) AS ignored_chars FROM vd GROUP BY 1)
SELECT a.*, b.* EXCLUDE (trace_scope) FROM a LEFT JOIN b USING (trace_scope)""")
def scope_report(t):
    return EV.use_report(_traces(t), _verdicts(t)).drop("use_rate", "low", "high")


@query(f"{_EV} SELECT event_type AS tool, count(*) AS traces, CAST(sum(cents) AS BIGINT) AS injected_chars FROM tr WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1")
def tool_report_in_window(t):
    """A bare end date counts to the end of its day."""
    return EV.use_report(_traces(t), _verdicts(t), by=("tool",), since="2024-01-05", until="2024-01-20").select("tool", "traces", "injected_chars")


@query(f"{_EV} SELECT node, CAST(sum(share) AS BIGINT) AS wasted, count(*) AS ignored FROM vd WHERE NOT used GROUP BY 1 ORDER BY wasted DESC, ignored DESC, node LIMIT 5")
def most_ignored(t):
    return EV.most_ignored(_traces(t), _verdicts(t))


@query(f"""{_EV}, d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (used) AS used, count(*) FILTER (NOT used) AS ignored, CAST(sum(CASE WHEN used THEN share END) AS BIGINT) AS used_chars, CAST(sum(CASE WHEN NOT used THEN share END) AS BIGINT) AS ignored_chars FROM vd GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, used, ignored, used_chars, ignored_chars, round(100.0 * used / nullif(used + ignored, 0), 2) AS used_pct FROM d""")
def daily_trend(t):
    return EV.daily_trend(_traces(t), _verdicts(t)).select(F.col("day").cast("string").alias("day"), "used", "ignored", "used_chars", "ignored_chars", "used_pct")


@query(f"{_EV} SELECT (SELECT count(*) FROM tr) AS written, (SELECT count(*) FROM tr WHERE nodes = 0) AS misses, (SELECT count(*) FROM tr WHERE k % 7 = 0) AS rejected, (SELECT count(*) FROM tr WHERE k % 11 = 0) AS legacy, count(used) AS attributed, count(*) FILTER (used) AS used, count(*) FILTER (NOT used) AS ignored, count(*) FILTER (used IS NULL) AS unjudged FROM vd")
def sync_counters(t):
    return EV.sync_counts(_traces(t), _verdicts(t))


@query(f"{_EV} SELECT CAST(event_id AS VARCHAR) AS trace_id FROM tr WHERE event_type NOT IN ('view', 'click')")
def traces_not_landed(t):
    """Landed are views and clicks; what is left is found by its content id."""
    tr = _traces(t)
    return EV.sync(tr.where(F.col("tool").isin("view", "click")), tr).select("trace_id")


def _pins(t: Tables) -> DataFrame:
    """Spawn rows of every event, its order that of the ledger; purchases are engaged rows."""
    e = t.events.select(F.col("user_id").cast("string").alias("session_id"), "event_type", "event_id", k().alias("k"))
    return e.select("session_id", F.concat(F.lit("exp"), (F.col("k") % 3).cast("string")).alias("scope"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("room"), (F.col("k") % 5).cast("string"))).alias("room"), F.when(F.col("event_type") == "purchase", "engaged").alias("event"), F.lit("pins").alias("path"), F.col("event_id").alias("line_no"))


_PINS = f"{_EV}, pin AS (SELECT user_id, arg_max('exp' || (k % 3), event_id) FILTER (event_type <> 'purchase') AS scope, arg_max('room' || (k % 5), event_id) FILTER (event_type <> 'purchase' AND k % 2 = 0) AS room, bool_or(event_type = 'purchase') AS engaged FROM ev GROUP BY 1)"


@query(f"{_PINS} SELECT CAST(user_id AS VARCHAR) AS session_id, scope FROM pin WHERE scope IS NOT NULL")
def dedup_latest(t):
    """The last spawn row of a session wins."""
    return L.pin_scopes(_pins(t))


@query(f"{_PINS} SELECT CAST(user_id AS VARCHAR) AS session_id, scope, room FROM pin WHERE scope IS NOT NULL")
def pin_facts(t):
    return L.launch_facts(_pins(t), ("scope", "room"))


@query(f"""{_PINS}, u AS (SELECT 'exp' || n AS expert, CASE WHEN scope = 'exp' || n THEN 'pinned' ELSE 'consulted' END AS role, count(*) AS returns, count(used) AS attributed, count(*) FILTER (used) AS used, CAST(sum(share) AS BIGINT) AS chars FROM vd GROUP BY 1, 2),
  s AS (SELECT scope AS expert, count(*) FILTER (engaged AND user_id NOT IN (SELECT user_id FROM tr WHERE event_type = 'view')) AS engaged_without_trace, count(*) FILTER (NOT engaged AND user_id NOT IN (SELECT user_id FROM tr WHERE event_type = 'view')) AS idle_spawns FROM pin WHERE scope IS NOT NULL GROUP BY 1)
SELECT expert, role, returns, attributed, used, chars, engaged_without_trace, idle_spawns FROM u FULL JOIN s USING (expert)""")
def pinned_vs_consulted(t):
    views = _traces(t)
    # Sessions are idle if none of their retrievals is a view.
    report = EV.pin_report(views, _verdicts(t), _pins(t)).drop("engaged_without_trace", "idle_spawns", "use_rate")
    state = EV.pin_report(views.where("tool = 'view'"), _verdicts(t), _pins(t)).select("expert", "engaged_without_trace", "idle_spawns").where("engaged_without_trace IS NOT NULL").distinct()
    return report.join(state, "expert", "full_outer").where("returns IS NOT NULL OR engaged_without_trace IS NOT NULL").select("expert", "role", "returns", "attributed", "used", "chars", "engaged_without_trace", "idle_spawns")


@query(f"""{_PINS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN event_type = 'signup' THEN 'extract' WHEN p.scope IS NULL THEN 'other' WHEN p.scope = 'exp0' THEN 'interactive' ELSE 'expert:' || p.scope END AS bucket,
  count(DISTINCT ev.user_id) AS sessions, count(*) AS calls, CAST(sum(CAST(trunc(1.0 * k + 1.25 * (event_id % 100) + 0.1 * (event_id % 1000) + 5.0 * (ev.user_id % 20)) AS BIGINT)) AS BIGINT) AS weight
FROM ev LEFT JOIN pin p ON p.user_id = ev.user_id WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1, 2""")
def cost_buckets(t):
    """Weighted tokens by day and operation; weights are truncated call by call, exp0 stands for the interactive scope."""
    from ..functions.stats import weighted_tokens

    e = t.events.where(F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz"))
    usage = e.select(F.to_date("ts").cast("string").alias("day"), F.col("user_id").cast("string").alias("session"), F.when(F.col("event_type") == "signup", "extract/1").otherwise("live").alias("path"), weighted_tokens(k(), F.col("event_id") % 100, F.col("event_id") % 1000, F.col("user_id") % 20).alias("weight"))
    pins = _pins(t).withColumn("scope", F.when(F.col("scope") == "exp0", "main").otherwise(F.col("scope")))
    return EV.cost_buckets(usage, pins)


@query(f"{_EV} SELECT count(*) AS retrievals, CAST(coalesce(sum(cents // 4), 0) AS BIGINT) AS injected_tokens, count(*) FILTER (nodes = 0) AS misses, arg_max(CAST(user_id AS VARCHAR), ts) AS current_session FROM tr WHERE CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM ev)")
def today_tile(t):
    rows = _traces(t).withColumn("response", F.repeat(F.lit("x"), F.col("injected_chars").cast("int")))
    last = rows.agg(F.max("ts")).first()[0]
    return EV.today(rows, F.lit(last))


@query(f"{_EV} SELECT event_type AS class, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS harness, count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM ev l WHERE l.user_id = f.user_id AND l.ts > f.ts AND l.event_type IN ('view', 'click', 'error'))) AS followed FROM (SELECT user_id, ts, CASE WHEN event_type = 'signup' THEN 'milestone' END AS event_type FROM ev WHERE event_type = 'signup') f GROUP BY 1, 2")
def conditioning_followed(t):
    """Sign-ups stand for milestones, which any later call follows; views, clicks and errors are the calls."""
    e = _traces(t)
    fired = e.where("tool = 'signup'").select("session_id", "ts", F.lit("milestone").alias("class"), F.when(F.col("session_id").cast("long") % 2 == 0, "a").otherwise("b").alias("harness"))
    return EV.conditioning_report(fired, e.where(F.col("tool").isin("view", "click", "error")).select("session_id", "ts", "tool"))


@query(f"""{_EV}, g AS (SELECT user_id, event_id, event_type, list_sort(list_distinct(['a' || (k % 5), 'b' || (k % 3), 'c' || (event_id % 2)])) AS fp FROM ev WHERE event_type IN ('error', 'purchase'))
SELECT count(*) FILTER (event_type = 'error') AS blocks, count(*) FILTER (event_type = 'error' AND EXISTS (SELECT 1 FROM g p WHERE p.event_type = 'purchase' AND p.user_id = b.user_id AND p.event_id > b.event_id AND len(list_intersect(p.fp, b.fp)) >= 2)) AS rescued,
  count(*) FILTER (event_type = 'purchase') AS passes, count(*) FILTER (event_type = 'error' AND EXISTS (SELECT 1 FROM g p WHERE p.event_type = 'error' AND p.user_id = b.user_id AND p.event_id > b.event_id AND p.fp = b.fp)) AS repeats FROM g b""")
def guard_report(t):
    fp = F.concat_ws(",", F.concat(F.lit("a"), (k() % 5).cast("string")), F.concat(F.lit("b"), (k() % 3).cast("string")), F.concat(F.lit("c"), (F.col("event_id") % 2).cast("string")))
    # The ledger's order is that of the events' numbers.
    at = F.date_format(F.timestamp_micros(F.col("event_id") * 1_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = t.events.where(F.col("event_type").isin("error", "purchase")).select(at.alias("ts"), F.col("user_id").cast("string").alias("session_id"), F.when(F.col("event_type") == "error", "block").otherwise("pass").alias("verdict"), F.lit("terminal").alias("branch"), fp.alias("fingerprint"), F.lit("").alias("command_hash"), F.lit(None).cast("string").alias("guard"), F.lit("g").alias("path"), F.col("event_id").alias("line_no"))
    return EV.guard_report(rows)


@query(f"""{_EV} SELECT sha256(CAST(k AS VARCHAR)) AS response_sha256, arg_max(CAST(event_id AS VARCHAR), event_id) AS seed, count(*) AS records FROM ev GROUP BY 1""")
def withholding_last(t):
    """The last draw recorded for each response."""
    rows = t.events.select(F.sha2(k().cast("string"), 256).alias("response_sha256"), F.lit("1").alias("version"), F.lit(0.5).alias("rate"), F.lit("s").alias("session_id"), F.lit("m").alias("scope"), F.lit("t").alias("tool"), F.lit("").alias("ts"), F.col("event_id").cast("string").alias("seed"), F.array(F.lit("a")).alias("offered"), F.array(F.lit("b")).alias("withheld"), F.lit("p").alias("path"), F.col("event_id").alias("line_no"))
    return L.withholdings(rows).select("response_sha256", "seed").join(rows.groupBy("response_sha256").agg(F.count("*").alias("records")), "response_sha256")


def _ceremonies(t: Tables) -> DataFrame:
    """Sign-ups start occasions, purchases end them, errors are skipped ones, clicks commit and views resolve deliverables."""
    e = t.events.select("event_id", "user_id", "event_type", k().alias("k"))
    event = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end").when(F.col("event_type") == "error", "skipped").when(F.col("event_type") == "click", "commitment").otherwise("resolution")
    occasion = F.col("event_type").isin("signup", "purchase")
    thing = F.col("event_type").isin("click", "view")
    return e.select(
        event.alias("event"), F.concat(F.lit("room"), (F.col("user_id") % 5).cast("string")).alias("room"), F.lit("review").alias("ceremony_kind"),
        F.when(occasion, F.concat(F.lit("o"), F.col("user_id").cast("string"))).alias("occasion_id"), F.when(thing, F.concat(F.lit("d"), F.col("k").cast("string"))).alias("deliverable_id"),
        F.when(F.col("event_type") == "view", F.when(F.col("k") % 3 == 0, "appeared").when(F.col("k") % 3 == 1, "lost").otherwise("absent")).alias("outcome"), F.when(F.col("k") % 4 != 0, "e").alias("evidence"), F.when(F.col("event_type") == "click", F.concat(F.lit("arm"), (F.col("event_id") % 2).cast("string"))).alias("arm"), F.lit("c").alias("path"), F.col("event_id").alias("line_no"),
    )


_CER = f"""{_EV}, o AS (SELECT 'o' || user_id AS id, min(event_id) FILTER (event_type = 'signup') AS started, min(event_id) FILTER (event_type = 'purchase') AS ended, count(*) FILTER (event_type = 'signup') AS starts, count(*) FILTER (event_type = 'purchase') AS ends FROM ev WHERE event_type IN ('signup', 'purchase') GROUP BY 1),
  d AS (SELECT 'd' || k AS id, min(event_id) FILTER (event_type = 'click') AS committed, min(event_id) FILTER (event_type = 'view') AS resolved, bool_or(event_type = 'view' AND k % 3 = 1) AS odd, bool_or(event_type = 'view' AND k % 4 = 0) AS bare FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1)"""


@query(f"""{_CER} SELECT 'ended without start' AS finding, id AS subject FROM o WHERE ended IS NOT NULL AND started IS NULL UNION ALL SELECT 'ended before start', id FROM o WHERE ended < started UNION ALL SELECT 'started twice', id FROM o WHERE starts > 1 UNION ALL SELECT 'ended twice', id FROM o WHERE ends > 1
UNION ALL SELECT 'resolved without commitment', id FROM d WHERE resolved IS NOT NULL AND committed IS NULL UNION ALL SELECT 'resolved before commitment', id FROM d WHERE resolved < committed UNION ALL SELECT 'unknown outcome', id FROM d WHERE odd UNION ALL SELECT 'outcome without evidence', id FROM d WHERE bare""")
def ledger_audit(t):
    rows = _ceremonies(t).withColumns({"event": F.col("event"), "reason": F.lit(None).cast("string")})
    return CE.audit(rows)


@query(f"{_EV} SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS INTEGER) AS occasion_index FROM ev WHERE event_type IN ('signup', 'error')")
def occasion_index(t):
    return CE.occasion_indices(_ceremonies(t)).select(F.col("line_no").alias("event_id"), F.col("index").alias("occasion_index"))


@query(f"{_EV} SELECT 'room' || (user_id % 5) AS room, 'review' AS ceremony_kind, count(*) + 1 AS next_index FROM ev WHERE event_type IN ('signup', 'error') GROUP BY 1")
def next_occasion(t):
    return CE.next_index(_ceremonies(t))


@query(f"{_EV} SELECT event_id FROM ev WHERE event_type = 'click' AND k NOT IN (SELECT k FROM ev WHERE event_type = 'view')")
def open_commitments(t):
    return CE.open_commitments(_ceremonies(t)).select(F.col("line_no").alias("event_id"))


@query(f"{_EV} SELECT 'd' || k AS deliverable_id, string_agg(CASE WHEN event_type = 'view' THEN CASE k % 3 WHEN 0 THEN 'appeared' WHEN 1 THEN 'lost' ELSE 'absent' END END, ',' ORDER BY event_id) AS outcomes, arg_max('arm' || (event_id % 2), event_id) FILTER (event_type = 'click') AS arm FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1")
def deliverable_history(t):
    outcomes = F.array_join("outcomes", ",")
    return CE.deliverable_history(_ceremonies(t)).select("deliverable_id", F.when(outcomes != "", outcomes).alias("outcomes"), "arm")


@query(f"{_EV}, r AS (SELECT ts, event_id, k % 3 AS fp, lag(k % 3) OVER (ORDER BY ts, event_id) AS before FROM ev) SELECT epoch_us(ts) AS at_us, CAST(fp AS VARCHAR) AS fingerprint FROM r WHERE fp IS DISTINCT FROM before")
def change_points(t):
    """Only the ledger rows at which the ranker's fingerprint changed."""
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    rows = t.events.select(at.alias("ts"), (k() % 3).cast("string").alias("fingerprint"), F.col("event_id").alias("line_no"), F.lit("r").alias("path"))
    return L.ranker_changes(rows).select(F.unix_micros("ts").alias("at_us"), "fingerprint")


@query(f"{_EV}, r AS (SELECT *, coalesce('d' || CASE WHEN event_type IN ('click', 'view') THEN k END, 'o' || user_id) AS subject FROM ev) SELECT 'unknown-arm' AS rule, subject, 'arm' || (event_id % 2) AS detail FROM r WHERE event_type = 'click' UNION ALL SELECT 'unknown-outcome', subject, 'lost' FROM r WHERE event_type = 'view' AND k % 3 = 1 UNION ALL SELECT 'no-evidence', subject, 'none' FROM r WHERE event_type = 'view' AND k % 4 = 0")
def ceremony_refusals(t):
    """Rows that the ledger's vocabulary refuses; every click names an arm that there is not."""
    return CE.refused_rows(_ceremonies(t)).where("subject IS NOT NULL")
