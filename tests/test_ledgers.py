from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from strataweave.plans import ceremonies as CE
from strataweave.plans import evaluation as EV
from strataweave.sources import ledgers as L
from strataweave.sources import transcripts as TR


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def tap(ts, session, tool, response, **tool_input):
    return {"ts": ts, "session_id": session, "scope": "main", "tool_name": tool, "tool_input": tool_input, "tool_response": response}


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    at = tmp_path_factory.mktemp("home")
    c1, c2 = "scope:main:claim:c1", "scope:lit:claim:k1"
    lines(at / "traces/2026-07.jsonl", [tap("2026-07-02T10:00:00Z", "s1", "mcp__memory__memory_recall", [{"type": "text", "text": json.dumps({"result": f"- `{c1}`\n- `{c2}`"})}], query="parser cache"), tap("2026-07-02T10:05:00Z", "s1", "mcp__memory__memory_recall", "No matching memories found.", query="zzz"), "not json", "", tap("2026-07-02T11:00:00Z", "s1", "memorize", "x")])
    lines(at / "traces/2026-06.jsonl", [tap("2026-06-01T09:00:00.000Z", "s2", "memory_query", {"result": "Rejected: mutating or side-effect step"}, query="g.V().drop()"), tap("2026-06-01T09:30:00Z", "s2", "bash_gremlin", "ok", command="echo marker"), tap("2026-06-01T09:40:00Z", "s2", "bash_gremlin", "ok", command="connect('x')")])
    lines(at / "rankers/rankers.jsonl", [{"ts": "2026-06-15T00:00:00", "fingerprint": "r1"}, {"ts": "2026-06-20T00:00:00Z", "fingerprint": "r1"}, {"ts": "2026-07-02T10:00:00Z", "fingerprint": "r2"}])
    lines(at / "pins/pins.jsonl", [{"session_id": "s1", "scope": "old", "room": "", "ts": "2026-07-01T00:00:00Z"}, {"session_id": "s1", "scope": "main", "room": "red"}, {"event": "engaged", "session_id": "s1", "scope": "x"}, {"session_id": "s3", "scope": "lit", "cwd": "/w"}, "junk", {"session_id": "s3", "scope": "lit2", "ts": "2026-01-01T00:00:00Z", "cwd": ""}])
    lines(at / "guards/2026-07.jsonl", [{"ts": f"2026-07-01T00:00:0{k}Z", "session_id": "g", "verdict": v, "branch": b, "fingerprint": f, "command_hash": h} for k, (v, b, f, h) in enumerate([("block", "", "v,out", "h1"), ("pass", "terminal", "v,out,count", "h2"), ("block", "", "v,in", "h3"), ("block", "", "v,in", "h4"), ("pass", "terminal", "e", "h5"), ("note", "", "", "")])])
    lines(at / "conditioning/2026-07.jsonl", [{"ts": "2026-07-02T09:59:00Z", "session_id": "s1", "class": "retrospect"}, {"ts": "2026-07-02T10:30:00Z", "session_id": "s1", "class": "design"}, {"ts": "2026-06-01T08:00:00Z", "session_id": "s2", "class": "milestone", "harness": "codex"}])
    lines(at / "ceremonies/c.jsonl", [{"event": "assigned", "occasion_id": "o1"}, {"event": "start", "room": "red", "ceremony_kind": "retro", "occasion_id": "o1", "ts_start": "2026-07-02T09:00:00Z"}, {"event": "end", "occasion_id": "o1", "ts_end": "2026-07-02T12:00:00Z"}, {"event": "start", "room": "red", "ceremony_kind": "retro", "occasion_id": "o2", "ts_start": "2026-07-02T10:00:00Z"}, {"event": "end", "occasion_id": "o2", "ts_end": "2026-07-02T10:30:00Z"}, {"event": "end", "occasion_id": "lost"}, {"event": "skipped", "room": "red", "ceremony_kind": "retro", "occasion_id": "o3"}, {"event": "commitment", "deliverable_id": "d1"}, {"event": "resolution", "deliverable_id": "d2", "outcome": "magic", "evidence": ""}])
    usage = lambda ts, **u: {"type": "assistant", "timestamp": ts, "message": {"content": "x", "usage": u}}
    lines(at / "projects/p/s1.jsonl", [
        {"type": "user", "uuid": "u1", "timestamp": "2026-07-02T09:50:00Z", "cwd": "/w", "message": {"content": "please fix the parser"}},
        {"type": "user", "uuid": "u2", "timestamp": "2026-07-02T09:51:00Z", "cwd": "/w", "isSidechain": True, "message": {"content": "side"}},
        {"type": "user", "uuid": "u3", "timestamp": "2026-07-02T09:52:00Z", "message": {"content": "<system>noise</system>"}},
        {"type": "assistant", "uuid": "a1", "timestamp": "2026-07-02T10:01:00Z", "gitBranch": "b1", "cwd": "/w", "message": {"content": [{"type": "text", "text": "The parser cache grows without bound"}, {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "/w/src/a.py"}}]}},
        {"type": "user", "uuid": "r1", "timestamp": "2026-07-02T10:02:00Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "done"}]}},
        {"type": "assistant", "uuid": "a2", "timestamp": "2026-07-02T10:03:00Z", "gitBranch": "b2", "cwd": "/w", "message": {"content": [{"type": "tool_use", "id": "t2", "name": "Edit", "input": {"file_path": "/w/src/a.py"}}]}},
        usage("2026-07-02T10:00:00.000Z", input_tokens=10, cache_creation_input_tokens=3, cache_read_input_tokens=9, output_tokens=2),
        usage("2026-07-02T11:00:00Z", input_tokens=1),
        usage("2026-07-03T11:00:00Z", output_tokens=1),
    ])
    return at


@pytest.fixture(scope="module")
def read(spark, home):
    return lambda name: L.ledger(spark, name, f"{home}/{name}")


def test_tap(read):
    got = L.tap_events(read("traces")).collect()
    assert [(r.ts.month, r.tool) for r in got] == [(6, "memory_query"), (6, "bash_gremlin"), (7, "memory_recall"), (7, "memory_recall")]
    assert [r.is_rejected for r in got] == [True, False, False, False] and [r.is_miss for r in got] == [False, False, False, True]
    assert list(got[2].returned) == ["scope:main:claim:c1", "scope:lit:claim:k1"] and got[2].query_text == "memory_recall: parser cache"
    assert not any(r.is_legacy for r in got)


def test_bad_lines_are_kept_on_request(spark, home):
    rows = L.ledger(spark, "traces", f"{home}/traces/2026-07.jsonl", strict=True).orderBy("line_no").collect()
    assert [r._corrupt is None for r in rows] == [True, True, False, True] and [r.line_no for r in rows] == [1, 2, 3, 4]


def test_pin_views(read):
    pins = read("pins")
    assert {r.session_id: r.scope for r in L.pin_scopes(pins).collect()} == {"s1": "main", "s3": "lit2"}
    assert {r.session_id: r.scope for r in L.first_dated_scope(pins).collect()} == {"s1": "old", "s3": "lit2"}
    assert {r.session_id: r.room for r in L.pin_rooms(pins).collect()} == {"s1": "red"}
    assert [r.session_id for r in L.engaged(pins).collect()] == ["s1"]
    assert {r.session_id: r.cwd for r in L.launch_facts(pins).collect()} == {"s1": None, "s3": "/w"}
    assert L.unique_prefix(pins, "s").first().error == "2 matches" and L.unique_prefix(pins, "s3").first().session_id == "s3"


def test_rankers(read):
    assert [r.fingerprint for r in L.ranker_changes(read("rankers")).orderBy("ts").collect()] == ["r1", "r2"]


def test_traces_verdicts_and_reports(spark, read, home):
    t = EV.traces(L.tap_events(read("traces")), read("rankers")).cache()
    got = {(r.session_id, r.tool, r.ts.minute): r for r in t.collect()}
    assert got["s1", "memory_recall", 0].ranker_config == "r2" and got["s2", "memory_query", 0].ranker_config == "unknown"
    again = EV.traces(L.tap_events(read("traces").unionByName(read("traces"))), read("rankers"))
    assert EV.sync(t, again).count() == 0 and again.count() == t.count()
    nodes = spark.createDataFrame([("scope:main:claim:c1", "Parser cache grows"), ("scope:lit:claim:k1", "unrelated theory entirely")], "vid string, content string")
    out = TR.output_window(TR.read_claude(spark, f"{home}/projects/*/*.jsonl"), t.select("trace_id", F.col("session_id").alias("session"), F.col("ts").alias("at")))
    v = EV.verdicts(t, nodes, out).cache()
    assert {r.node: (r.used, r.evidence) for r in v.collect()} == {"scope:main:claim:c1": (True, "matched 3/3 terms: cache, grows, parser"), "scope:lit:claim:k1": (False, "matched 0/3 terms: none")}
    rep = EV.use_report(t, v, by=("tool",)).where("tool = 'memory_recall'").first()
    assert (rep.traces, rep.sessions, rep.misses, rep.returns, rep.used, rep.use_rate) == (2, 1, 1, 2, 1, None)
    assert EV.use_report(t, v, since="2026-07-02", until="2026-07-02").first().traces == 2
    assert EV.most_ignored(t, v).first().node == "scope:lit:claim:k1"
    assert EV.daily_trend(t, v).first().used_pct == 50.0
    pins = {(r.expert, r.role): r.used for r in EV.pin_report(t.withColumn("trace_scope", F.col("scope")), v, read("pins")).where("role IS NOT NULL").collect()} if "trace_scope" not in t.columns else {(r.expert, r.role): r.used for r in EV.pin_report(t, v, read("pins")).where("role IS NOT NULL").collect()}
    assert pins == {("main", "pinned"): 1, ("lit", "consulted"): 0}
    counts = EV.sync_counts(t, v).first()
    assert (counts.written, counts.misses, counts.rejected, counts.used, counts.ignored) == (4, 1, 1, 1, 1)
    assert {(r.tool, r["class"]): r.n for r in EV.query_classes(L.tap_events(read("traces"))).collect()} == {("memory_query", "mutation"): 1, ("bash_gremlin", "ok"): 1}
    assert EV.live_feed(L.tap_events(read("traces")), read("guards")).count() == 9


def test_verdict_ladder(spark):
    rows = [("scope:m:claim:c9", "x", "see SCOPE:M:CLAIM:C9"), ("scope:m:thread:parse", "x", "the parse thread"), ("scope:m:thread:abc", "the of", "abc"), ("n", "alpha beta gamma delta", "alpha"), ("n", "alpha", "alpha!")]
    used, why = EV.verdict(F.col("n"), F.col("c"), F.col("o"))
    got = spark.createDataFrame(rows, "n string, c string, o string").select(used.alias("u"), why.alias("w")).collect()
    assert [r.u for r in got] == [True, True, False, False, True] and got[2].w == "no distinctive terms to match on"
    judged = EV.judge_grid(spark.createDataFrame([("t", "n", "alpha beta gamma delta", "alpha beta")], "trace_id string, node string, content string, output string"), [{"name": "shipped"}, {"name": "strict", "terms": 3, "ratio": 0.9}])
    assert {r.judge: r.used for r in judged.collect()} == {"shipped": True, "strict": False}


def test_guards_and_conditioning(read):
    g = EV.guard_report(read("guards")).first()
    assert (g.blocks, g.passes, g.rescued, g.repeats) == (3, 2, 1, 1)
    c = {(r["class"], r.harness): (r.total, r.followed) for r in EV.conditioning_report(L.firings(read("conditioning")), L.tap_events(read("traces"))).collect()}
    assert c == {("retrospect", "claude-code"): (1, 1), ("design", "claude-code"): (1, 0), ("milestone", "codex"): (1, 1)}


def test_transcript_facts_and_cost(spark, read, home):
    rows = TR.read_claude(spark, f"{home}/projects/*/*.jsonl")
    f = TR.session_facts(rows).first()
    assert (f.session, f.cwd, f.branch, f.user_turns, f.tool_calls, f.prompt, f.has_substance) == ("s1", "/w", "b2", 1, 2, "please fix the parser", True)
    assert [(r.identifier, r.anchors) for r in TR.touched_files(rows).collect()] == [("src/a.py", ["a1", "a2"])]
    assert {(r.call_id, r.result) for r in TR.call_results(rows).collect()} == {("t1", "done"), ("t2", None)}
    u = TR.usage(rows)
    assert sorted(r.weight for r in u.collect()) == [1, 5, 24] and TR.usage(rows, since="2026-07-03").count() == 1
    b = {(str(r.day), r.bucket): r.weight for r in EV.cost_buckets(u, read("pins")).collect()}
    assert b == {("2026-07-02", "interactive"): 25, ("2026-07-03", "interactive"): 5}
    burn = {r.occasion_id: (r.calls, r.weight) for r in EV.occasion_burn(u, read("pins"), read("ceremonies")).collect()}
    assert burn == {"o2": (1, 24), "o1": (1, 1), None: (1, 5)}
    delta = TR.fork_delta(rows, rows.where("uuid <> 'a2'"))
    assert delta.where("uuid = 'a2'").count() == 1 and delta.where("uuid IS NULL").count() == 3
    digest = TR.digest_lines(rows)
    assert digest.where("line like '[user] please%'").count() == 1
    assert TR.elide_middle(digest, budget=60).count() < digest.count()


def test_ceremonies(spark, read):
    rows = read("ceremonies")
    found = {(r.finding, r.subject) for r in CE.audit(rows).collect()}
    assert found == {("ended without start", "lost"), ("resolved without commitment", "d2"), ("unknown outcome", "d2"), ("outcome without evidence", "d2")}
    assert {r.occasion_id: r["index"] for r in CE.occasion_indices(rows).collect()} == {"o1": 1, "o2": 2, "o3": 3}
    assert CE.next_index(rows).first().next_index == 4 and CE.open_commitments(rows).count() == 1
    units = spark.createDataFrame([(f"u{k}",) for k in range(10)], "unit string")
    a, b = (sorted(map(tuple, CE.draw(units, [("x", 4), ("y", 6)], s).collect())) for s in ("1", "1"))
    assert a == b and sum(x == "x" for _, x in a) == 4 and CE.assignment_space([4, 6]) == 210
