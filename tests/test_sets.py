from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from strataweave.operators import sets as SE
from strataweave.plans import ceremonies as CE
from strataweave.plans import writers as WR
from strataweave.sources import ledgers as L


def test_sets_lists_and_ratios(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["a", "b", "b", None], ["b", "c"]))
    assert {(r.k, r.side) for r in SE.symmetric_difference(a.where("k is not null"), b, key="k").collect()} == {("a", "left"), ("c", "right")}
    lists = spark.createDataFrame([("x", 1, ["a"]), ("x", 2, ["a", "b"]), ("x", 3, ["a", "b"]), ("y", 1, ["a", "b"]), ("y", 2, ["b", "a", "c"]), ("z", 1, [])], "k string, n int, items array<string>")
    assert {r.k: r.consistent for r in SE.consistent_chain(lists, key="k", order="n", items="items").collect()} == {"x": True, "y": False, "z": True}
    s = spark.createDataFrame([(1, "p", 0), (0, "p", 3), (2, " ", 0), (2, None, 1), (None, None, None)], "t int, p string, n int")
    assert [r[0] for r in s.select(SE.has_substance(F.col("t"), F.col("p"), F.col("n"))).collect()] == [True, False, False, True, False]
    usage = spark.createDataFrame([("s", 10, None, 30), ("s", 0, 60, 0), ("e", 0, 0, 0)], "s string, input_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long")
    assert {r.s: r.ratio for r in SE.cache_hit_ratio(usage, group="s").collect()} == {"s": 0.3, "e": None}
    proofs = spark.createDataFrame([("r", None), ("r", True), ("q", False)], "root string, ok boolean")
    assert [r.root for r in SE.proven_roots(proofs, root="root", proof="ok").collect()] == ["r"]
    edges = spark.createDataFrame([("a", "module", "import"), ("b", "deferred", "import"), ("c", "module", "typing")], "src string, depth string, kind string")
    assert [r.src for r in SE.import_policy(edges).collect()] == ["a"]


def test_texts_rosters_and_windows(spark):
    t = spark.createDataFrame([("Fix it", "please\n fix  this"), (" ", None)], "title string, prompt string")
    assert [r[0] for r in t.select(SE.summary_line(F.col("title"), F.col("prompt"))).collect()] == ["Fix it — please fix this", ""]
    c = spark.createDataFrame([("a\nb\nc", '{"query": "x\\n y", "path": "p"}'), ("ab", "{}")], "text string, args string")
    assert [tuple(r) for r in c.select(SE.capped_text(F.col("text"), lines=2, chars=9), SE.call_summary(F.col("args"), ("command", "query"))).collect()] == [("a\nb…", "x y"), ("ab", "")]
    assert c.select(SE.protocol_hash(F.lit("p"))).first()[0] == hashlib.sha256(b"p").hexdigest()[:12]
    one, two = spark.createDataFrame([("s1", "m", None), ("s2", None, "h")], "id string, scope string, harness string"), spark.createDataFrame([("s2", "z", "other"), ("s3", "a", "h")], "id string, scope string, harness string")
    assert [tuple(r) for r in SE.merged_roster(one, two, key="id", columns=("scope", "harness")).collect()] == [("s3", "a", "h"), ("s1", "m", None), ("s2", "z", "h")]
    rows = spark.createDataFrame([("a", False, 3), ("b", True, 1), ("c", True, 2)], "id string, live boolean, at int")
    assert [r.id for r in SE.active_first(rows, active=F.col("live"), at="at").collect()] == ["c", "b", "a"]
    pins = spark.createDataFrame([("s1", "%1", None, "p", 1), ("s2", "%1", None, "p", 2), ("s3", "%9", "engaged", "p", 3)], "session_id string, tmux_pane string, event string, path string, line_no int")
    windows = spark.createDataFrame([("w1", "%1"), ("w2", "%9"), ("w3", None)], "window string, pane string")
    near = spark.createDataFrame([("w2", "s7")], "window string, session_id string")
    got = {r.window: (r.session_id, r.found_by) for r in SE.window_ledger_join(windows, pins, fallback=near).collect()}
    assert got == {"w1": ("s2", "pane"), "w2": ("s7", "time"), "w3": (None, None)}
    manifests = spark.createDataFrame([("a", "main", ["x"], ["paper/x"]), ("b", "lit", [], ["bare"]), ("c", "lit", ["y"], [])], "name string, scope string, allow array<string>, kinds array<string>")
    assert {(r.rule, r.subject) for r in SE.check_manifests(manifests).collect()} == {("scope", "a"), ("scope-twice", "b"), ("scope-twice", "c"), ("allows-nothing", "b"), ("bare-kind", "b")}
    v = spark.createDataFrame([("Session", "s1", "m"), ("Session", "s1", "l"), ("Claim", "s1", "x")], "label string, session_id string, scope string")
    assert {r.scope for r in SE.scopes_of_session(v, "s1").collect()} == {"m", "l"}


def test_appends_blobs_and_receipts(spark, tmp_path):
    rows = spark.createDataFrame([("s1", None, 3)], "session_id string, scope string, n int")
    for _ in range(2):
        WR.append_lines(rows, f"{tmp_path}/ledger")
    assert [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/ledger").collect()] == [{"n": 3, "session_id": "s1"}] * 2
    blobs = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b"y"),)], "content binary")
    held = spark.createDataFrame([(hashlib.sha256(b"y").hexdigest(),)], "hash string")
    assert [(r.hash, bytes(r.content)) for r in WR.new_blobs(blobs, held).collect()] == [(hashlib.sha256(b"x").hexdigest(), b"x")]
    now, before = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int"), spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    assert {r.k for r in WR.changed_only(now, before, key="k", value="v").collect()} == {"b", "c"}
    items = spark.createDataFrame([("d", 2, "two", True), ("d", 1, "one", True), ("d", 3, "no", False)], "document string, place int, text string, selected boolean")
    r = WR.ingress_receipts(items).first()
    assert (r.selected, r.discarded, r.selected_digest, r.discarded_digest) == (2, 1, hashlib.sha256(b"one\ntwo").hexdigest(), hashlib.sha256(b"no").hexdigest())
    record = spark.createDataFrame([("k", "true id", "")], "key string, id string, title string")
    model = spark.createDataFrame([("k", "made up", "a title", "extra")], "key string, id string, title string, more string")
    assert tuple(WR.merged_with_record(record, model, key="key", identity=("id",)).first()) == ("k", "true id", "a title", "extra")


def test_acknowledgements_name_live_findings(spark):
    found = spark.createDataFrame([("ended twice", "o1"), ("unknown outcome", "d2")], "finding string, subject string")
    acks = spark.createDataFrame([("ended-twice:o1", "old", "p", 1), ("ended-twice:o1", "known", "p", 2), (None, "x", "p", 3)], "finding string, reason string, path string, line_no int")
    last = L.acknowledgements(acks)
    assert [tuple(r) for r in last.collect()] == [("ended-twice:o1", "known")]
    assert [r.subject for r in CE.unacknowledged(found, last).collect()] == ["d2"]
    asked = spark.createDataFrame([("ended-twice:o1", "fine"), ("ended-twice:o9", "fine"), ("unknown-outcome:d2", " ")], "finding string, reason string")
    assert {tuple(r) for r in CE.refused_acknowledgements(found, asked).collect()} == {("ended-twice:o9", "not a current finding"), ("unknown-outcome:d2", "no reason")}
