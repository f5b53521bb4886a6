from __future__ import annotations

import json
import time

from pyspark.sql import functions as F

from strataweave.streaming import ledgers as S


def write(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)) + "\n")


def drain(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_landing_is_idempotent_and_keeps_late_rows(spark, tmp_path):
    tap, out, check = tmp_path / "traces", str(tmp_path / "out"), str(tmp_path / "check")
    row = lambda s, ts: {"ts": ts, "session_id": s, "tool_name": "t"}
    write(tap, "1.jsonl", [row("a", "2026-07-01T00:00:00Z"), row("a", "2026-07-01T00:00:00Z"), row("b", "2026-07-02T00:00:00Z")])
    stream = lambda: S.tap_stream(spark, "traces", str(tap)).withColumn("id", F.sha2(F.concat("session_id", "ts"), 256))
    S.land(stream(), out, check, key="id").awaitTermination(120)
    write(tap, "2.jsonl", [row("b", "2026-07-02T00:00:00Z"), row("old", "2020-01-01T00:00:00Z")])
    S.land(stream(), out, check, key="id").awaitTermination(120)
    assert sorted(r.session_id for r in spark.read.parquet(out).collect()) == ["a", "b", "old"]
    events = spark.createDataFrame([("x",), (spark.read.parquet(out).first().id,)], "id string")
    assert [r.id for r in S.pending(events, spark.read.parquet(out), key="id").collect()] == ["x"]


def test_windows(spark, tmp_path):
    rows = [{"ts": f"2026-07-0{1 + k // 3}T0{k % 3}:00:00Z", "session_id": "s"} for k in range(9)]
    write(tmp_path / "g", "1.jsonl", rows)
    got = drain(spark, S.tumbling(S.tap_stream(spark, "guards", str(tmp_path / "g")), "session_id"), "tumbling", "complete")
    assert sorted((r.start.day, r.n) for r in got.collect()) == [(1, 3), (2, 3), (3, 3)]
    got = drain(spark, S.sessions(S.tap_stream(spark, "guards", str(tmp_path / "g")), "session_id", gap="90 minutes"), "gaps", "complete")
    assert sorted(r.n for r in got.collect()) == [3, 3, 3]
    got = drain(spark, S.once_each(S.tap_stream(spark, "guards", str(tmp_path / "g")), "session_id", delay="30 days"), "once", "append")
    assert got.count() == 1
    got = drain(spark, S.last_rows(S.tap_stream(spark, "guards", str(tmp_path / "g")), key="session_id", value="ts", order="at"), "last", "complete")
    assert got.first().ts == "2026-07-03T02:00:00Z"
    got = drain(spark, S.sliding(S.tap_stream(spark, "guards", str(tmp_path / "g")), length="2 days"), "sliding", "complete")
    assert sorted(r.n for r in got.collect()) == [3, 3, 6, 6]


def test_calls_meet_results_across_batches(spark, tmp_path):
    at = tmp_path / "calls"
    write(at, "1.jsonl", [{"session": "s", "kind": "call", "call_id": "1", "body": "in"}, {"session": "s", "kind": "result", "call_id": "2", "body": "early"}])
    stream = spark.readStream.schema("session string, kind string, call_id string, body string").option("maxFilesPerTrigger", 1).json(str(at))
    write(at, "2.jsonl", [{"session": "s", "kind": "result", "call_id": "1", "body": "out"}, {"session": "s", "kind": "call", "call_id": "2", "body": "late"}])
    got = drain(spark, S.resolved_calls(stream), "calls", "append")
    assert {(r.call_id, r.call, r.result) for r in got.collect()} == {("1", "in", "out"), ("2", "late", "early")}


def test_run_states(spark, tmp_path):
    rows = spark.createDataFrame([("a", "run", "2026-01-01 10:00:00"), ("b", "run", "2026-01-01 09:35:00"), ("c", "run", "2026-01-01 08:00:00"), ("d", "done", "2026-01-01 08:00:00")], "session string, status string, at string").withColumn("at", F.to_timestamp("at"))
    got = {r.session: r.state for r in S.run_states_at(rows, F.lit("2026-01-01 10:00:00").cast("timestamp")).collect()}
    assert got == {"a": "active", "b": "stalled", "c": "abandoned", "d": "done"}
    write(tmp_path / "runs", "1.jsonl", [{"session": "a", "status": "run"}, {"session": "b", "status": "done"}])
    stream = spark.readStream.schema("session string, status string").json(str(tmp_path / "runs"))
    q = S.run_states(stream).writeStream.format("memory").queryName("runs").outputMode("update").trigger(once=True).start()
    q.awaitTermination(120)
    assert {r.session: r.state for r in spark.table("runs").collect()} == {"a": "active", "b": "done"}


def bounded(spark, df, name, check, mode="append"):
    q = df.writeStream.format("parquet").option("path", f"{check}-out").option("checkpointLocation", check).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.read.schema("path string, start long, value string").parquet(f"{check}-out")


def test_tail_reads_files_that_grow_are_torn_and_cut(spark, tmp_path):
    spark.dataSource.register(S.TailSource)
    at, check = tmp_path / "log", str(tmp_path / "check")
    at.mkdir()
    read = lambda: bounded(spark, spark.readStream.format("tail").options(path=str(at), glob="*.jsonl", splitBytes="64").load(), "tail", check)
    values = lambda df: sorted((r.path.rsplit("/", 1)[1], r.start, r.value) for r in df.collect())
    a, b = at / "a.jsonl", at / "b.jsonl"
    a.write_bytes(b"one\ntwo\nthr")
    (at / "other.txt").write_text("no\n")
    want = [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    assert values(read()) == want
    with a.open("ab") as f:
        f.write(b"ee\r\nfour\n\n" + "é".encode() * 100 + b"\n" + b"".join(b"line %d\n" % k for k in range(60)) + b"half")
    b.write_bytes(b"new\n")
    text = a.read_bytes()
    place, want = 0, [("b.jsonl", 0, "new")]
    for line in text.split(b"\n")[:-1]:
        want.append(("a.jsonl", place, line.rstrip(b"\r").decode()))
        place += len(line) + 1
    assert values(read()) == sorted(want)
    assert values(read()) == sorted(want)  # nothing new, nothing twice
    b.write_bytes(b"x\n")  # cut short: read anew
    a.write_bytes(b"ANOTHER file of the same name\n" + b"z" * len(text) + b"\n")  # longer, but not a continuation
    want += [("b.jsonl", 0, "x"), ("a.jsonl", 0, "ANOTHER file of the same name"), ("a.jsonl", 30, "z" * len(text))]
    assert values(read()) == sorted(want)


def test_tail_of_a_ledger_equals_its_batch_read(spark, tmp_path):
    from strataweave.sources import ledgers as L

    at = tmp_path / "guards"
    write(at, "2026-07.jsonl", [{"ts": f"2026-07-0{1 + k % 9}T00:00:00Z", "session_id": f"s{k}"} for k in range(40)])
    with (at / "2026-07.jsonl").open("a") as f:
        f.write("not json\n")
    got = drain(spark, S.tail_stream(spark, "guards", str(at)).select("session_id", "at"), "tailed", "append")
    want = L.ledger(spark, "guards", str(at)).select("session_id", L.parse_time(F.col("ts")).alias("at"))
    rows = lambda df: sorted(map(tuple, df.where("session_id IS NOT NULL").collect()))
    assert rows(got) == rows(want)
    q = S.tail_stream(spark, "guards", str(at), maxBytesPerTrigger="900").select("session_id", "at").writeStream.format("memory").queryName("pieces").trigger(processingTime="100 milliseconds").start()
    try:
        assert any(spark.table("pieces").count() >= 40 or time.sleep(0.5) for _ in range(120))
        assert rows(spark.table("pieces")) == rows(want) and len([x for x in q.recentProgress if x["numInputRows"]]) > 2
    finally:
        q.stop()


def test_landing_reads_only_its_buckets(spark, tmp_path):
    tap, out, check = tmp_path / "traces", str(tmp_path / "out"), str(tmp_path / "check")
    stream = lambda: S.tap_stream(spark, "traces", str(tap)).withColumn("id", F.sha2(F.col("session_id"), 256))
    row = lambda k: {"ts": "2026-07-01T00:00:00Z", "session_id": f"s{k}"}
    write(tap, "1.jsonl", [row(k) for k in range(400)])
    S.land(stream(), out, check, key="id").awaitTermination(120)
    bucket = {r.session_id: r.bucket for r in spark.read.parquet(out).collect()}
    write(tap, "2.jsonl", [row(7), row(7), row(400)])
    S.land(stream(), out, check, key="id").awaitTermination(120)
    assert sorted(r.session_id for r in spark.read.parquet(out).collect()) == sorted(f"s{k}" for k in range(401))
    files = S.landed_in(spark, out, [bucket["s7"]]).inputFiles()
    assert 1 <= len(files) <= 2 and all(f"/bucket={bucket['s7']}/" in f for f in files)
    second = [f for f in spark.read.parquet(out).where("number > 0").inputFiles() if "/number=0/" not in f]
    assert len(second) == 1
    assert S.compact_landed(spark, out, f"{out}-2").count() == 401
    assert S.landed_in(spark, out, [10_000]) is None


def test_open_calls_expire_and_late_results_update_their_item(spark, tmp_path):
    at, out = tmp_path / "calls", str(tmp_path / "items")
    row = lambda kind, call, body: {"session": "s", "kind": kind, "call_id": call, "body": body}
    write(at, "1.jsonl", [row("call", "1", "in"), row("call", "2", "slow"), row("result", "3", "early"), row("result", "1", None)])
    stream = spark.readStream.schema("session string, kind string, call_id string, body string").json(str(at))
    q = S.resolved_calls(stream, expire_s=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-check").outputMode("append").trigger(processingTime="300 milliseconds").start()
    held = lambda: (q.lastProgress or {"stateOperators": [{"numRowsTotal": -1}]})["stateOperators"][0]["numRowsTotal"]
    items = lambda: {r.call_id: (r.call, r.result, r.status) for r in S.latest_calls(spark.read.schema("session string, call_id string, call string, result string, status string").parquet(out)).collect()}
    wait = lambda done: next((True for _ in range(200) if done() or time.sleep(0.3)), False)
    try:
        assert wait(lambda: q.lastProgress and held() == 2 or held() == 0)
        assert wait(lambda: held() == 0)
        assert wait(lambda: len(items()) == 3)
        assert items() == {"1": ("in", "", "resolved"), "2": ("slow", None, "expired"), "3": (None, "early", "unmatched")}
        write(at, "2.jsonl", [row("result", "2", "late"), row("call", "3", "later")])
        assert wait(lambda: {v[2] for v in items().values()} == {"resolved", "late"})
        assert items()["2"] == ("slow", "late", "late") and items()["3"] == ("later", "early", "late")
        assert wait(lambda: held() == 0)
    finally:
        q.stop()
