from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strataweave.functions import ids as I
from strataweave.functions import stats as S
from strataweave.functions import text as X
from strataweave.operators import containment as N
from strataweave.operators import contract as C
from strataweave.operators import joins as J
from strataweave.operators import ranking as R
from strataweave.schema import EDGE, VERTEX


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert X.keywords("What is the Parser-Cache, doing") == ["parser-cache,", "doing"]
    assert one(spark, X.keywords_of(lit("What is the Parser-Cache, doing"))) == ["parser-cache,", "doing"]
    assert one(spark, X.terms(lit("b/c the A.b zeta zeta"))) == ["a.b", "b/c", "zeta"]
    assert one(spark, X.compound_tokens(lit("tool-calls x"))) == ["tool-calls", "tool", "calls", "x"]
    assert one(spark, X.normal_description(lit("  a \n b... "))) == "a b"
    assert one(spark, X.step_fingerprint(lit("g.V().has_label('x') . outE( )"))) == ["v", "haslabel", "oute"]
    assert one(spark, X.html_text(lit("<p>a<script>x</script> &lt;b&gt; &amp;amp;</p>"))) == "a <b> &amp;"
    assert one(spark, X.slug(lit(" Ab, C d! "))) == "ab-c-d"
    assert one(spark, X.path_slug(lit("/a/b.c"))) == "-a-b-c"
    assert one(spark, X.clip(lit("abcdef"), 3)) == "abc…"
    assert one(spark, X.backtick_ids(lit("see scope:main:claim:x1, ok"))) == "see `scope:main:claim:x1`, ok"
    assert one(spark, X.returned_ids(lit("`scope:a:claim:1` `scope:a:thread:t` `scope:a:claim:1`"))) == ["scope:a:claim:1", "scope:a:thread:t"]
    assert one(spark, lit("src/a/b.py").rlike(X.glob_regex("src/*.py")))
    assert one(spark, X.human_bytes(lit(2048))) == "2.0 KiB"
    assert one(spark, X.is_miss(lit(" No matching memories found. "))) and not one(spark, X.is_miss(lit("x No matching memories found.")))
    assert one(spark, X.is_rejected(lit("Query failed: x")))
    planted = "AKIA" + "A" * 16 + " -----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36 + " hf_" + "b" * 34 + " xoxb-" + "1" * 10 + " sk-" + "c" * 32 + " feature-key-version Authorization: Bearer " + "d" * 20 + " privatekey = " + "e" * 43 + "= sk-ant-" + "f" * 20
    hits = spark.range(1).select(*[c.alias(n) for n, c in X.secret_hits(F.lit(planted)).items()]).first().asDict()
    assert all(v == 1 for v in hits.values()) and len(hits) == 10


def test_ids(spark):
    assert one(spark, I.vertex_id(F.lit("main"), "claim", F.lit("c"))) == "scope:main:claim:c"
    assert one(spark, I.vertex_id(F.lit(None).cast("string"), "agent", F.lit("a"))) == "agent:a"
    assert one(spark, I.scope_of(F.lit("scope:main:claim:a:b"))) == "main" and one(spark, I.scope_of(F.lit("agent:a"))) is None
    assert not one(spark, I.crosses_scope(F.lit("scope:a:claim:1"), F.lit("agent:x"))) and one(spark, I.crosses_scope(F.lit("scope:a:claim:1"), F.lit("scope:b:claim:1")))
    want = hashlib.sha256('{"description":"caf\\u00e9 x","kind":"problem"}'.encode()).hexdigest()[:16]
    assert one(spark, I.claim_id(F.lit("problem"), F.lit(" café  x.. "))) == want
    want = hashlib.sha256(b'{"input":{"a":1,"b":2},"session_id":"s\\"1","tool":"t","ts":"z"}').hexdigest()[:16]
    assert one(spark, I.trace_id(F.lit('s"1'), F.lit("z"), F.lit("t"), F.lit('{"b": 2, "a":1}'))) == want
    assert one(spark, I.chunk_id(F.lit("h"), F.lit(7))) == "h-0007"


def test_stats(spark):
    low, high = S.wilson(F.lit(0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0.0, 1.0)
    low, high = S.wilson(F.lit(20), F.lit(40))
    assert abs(one(spark, low) - 0.352) < 1e-3 and abs(one(spark, high) - 0.648) < 1e-3
    assert one(spark, S.rate(F.lit(3), F.lit(19))) is None
    assert one(spark, S.weighted_tokens(F.lit(10), F.lit(3), F.lit(9), F.lit(2))) == 24
    pts = spark.createDataFrame([(float(i), float(2 * i)) for i in range(30)] + [(30.0, 900.0)], "x double, y double")
    assert S.sens_slope(pts, "x", "y").first().slope == 2.0
    assert S.sens_slope(pts, "x", "y", cells=10).first().slope == 2.0
    assert S.sens_slope(pts.limit(1), "x", "y").first().slope == 0.0
    assert round(one(spark, S.contrast(F.lit("#ffffff"), F.lit("#000000"))), 2) == 21.0


def test_slope_of_a_long_series_takes_all_pairs(spark):
    """Beyond 2,000 points every other one, here all of the slow kind, used to be left out."""
    import numpy as np

    y = np.array([3.0 * i if i % 2 else i**1.5 / 100 for i in range(2100)])
    i, j = np.triu_indices(len(y), 1)
    want = float(np.median((y[j] - y[i]) / (j - i)))
    pts = spark.createDataFrame([(float(k), float(v)) for k, v in enumerate(y)], "x double, y double")
    assert abs(S.sens_slope(pts, "x", "y").first().slope - want) < 1e-9
    assert abs(S.sens_slope(pts, "x", "y", cells=2000).first().slope - want) > 1e-3


def test_as_of_before_first_equal_times_and_gaps(spark):
    left = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00"), (3, "2024-03-05 12:00:00"), (4, None)], "id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    right = spark.createDataFrame([("2024-01-02 00:00:00", "a"), ("2024-01-02 00:00:01", "b")], "ts string, v string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.id: r.v for r in J.as_of_join(left, right, left_ts="ts", right_ts="ts", value="v", default="unknown").collect()}
    assert got == {1: "unknown", 2: "a", 3: "b", 4: "unknown"}


def test_interval_join_is_innermost(spark):
    ts = lambda df, *cs: df.withColumns({c: F.to_timestamp(c) for c in cs})
    calls = ts(spark.createDataFrame([(1, "r", "2024-01-01 10:00:00"), (2, "r", "2024-01-01 10:15:00"), (3, "r", "2024-01-03 00:00:00"), (4, "q", "2024-01-01 10:00:00")], "id int, room string, at string"), "at")
    spans = ts(spark.createDataFrame([("outer", "r", "2024-01-01 10:00:00", "2024-01-02 01:00:00"), ("inner", "r", "2024-01-01 10:10:00", "2024-01-01 10:20:00"), ("open", "r", "2024-01-02 12:00:00", None)], "oid string, room string, s string, e string"), "s", "e")
    got = {r.id: r.oid for r in J.interval_join(calls, spans, key="room", at="at", start="s", end="e", span_id="oid", call_id=["id"]).collect()}
    assert got == {1: "outer", 2: "inner", 3: "open", 4: None}


def test_rescue_and_followed(spark):
    blocks = spark.createDataFrame([("s", 1, ["a", "b"]), ("s", 5, ["a"]), ("s", 6, []), ("t", 1, ["z"])], "k string, p int, fp array<string>")
    passes = spark.createDataFrame([("s", 3, ["b", "a", "c"]), ("s", 7, ["q"])], "k string, p int, fp array<string>")
    got = {(r.k, r.p): r.rescued for r in J.rescued(blocks, passes, key="k", pos="p", prints="fp").collect()}
    assert got == {("s", 1): True, ("s", 5): False, ("s", 6): True, ("t", 1): False}


def test_affixes_contains_and_precedence(spark):
    left = spark.createDataFrame([(1, "/home/u/repo/src/a.py"), (2, "/other/x")], "id int, path string")
    right = spark.createDataFrame([("/home/u",), ("/home/u/repo",), ("/home/u/rep",)], "root string")
    assert [(r.id, r.root) for r in J.longest_affix(left, right, path="path", affix="root", row_id="id").collect()] == [(1, "/home/u/repo")]
    tails = spark.createDataFrame([("a.py",), ("src/a.py",), ("c/a.py",)], "t string")
    assert [(r.id, r.t) for r in J.longest_affix(left, tails, path="path", affix="t", row_id="id", suffix=True).collect()] == [(1, "src/a.py")]
    a = spark.createDataFrame([(1, None, "x"), (2, "u", None)], "k int, a string, b string")
    b = spark.createDataFrame([(2, "w", "y"), (3, "v", None)], "k int, a string, b string")
    got = {r.k: (r.a, r.b, r.found_by) for r in J.merge_by_precedence([a, b], key="k", columns=["a", "b"], names=["hook", "file"]).collect()}
    assert got == {1: (None, "x", "hook"), 2: ("u", "y", "file,hook"), 3: ("v", None, "file")}


@pytest.mark.parametrize(("shard", "cut"), [(1 << 22, 1 << 19), (3, 16)])
def test_contains_join_in_one_pass_and_in_shards(spark, monkeypatch, shard, cut):
    monkeypatch.setattr(N, "SHARD_NAMES", shard)
    monkeypatch.setattr(N, "SLICE", cut)
    texts = spark.createDataFrame([(1, "Attention is all you Need"), (2, "lstm"), (3, None), (4, "x"), (5, ""), (6, "\U0001f600x\u00e9 lst"), (6, "m")], "id int, text string")
    names = spark.createDataFrame([("is all you need",), ("LSTM",), ("attention",), ("",), (None,), ("x",), ("\U0001f600X\u00c9",), ("x",)], "name string")
    got = sorted((r.id, r.name) for r in J.contains_join(texts, names, text="text", name="name").collect())
    assert got == sorted([(1, "is all you need"), (1, "attention"), (2, "LSTM"), (4, "x"), (4, "x"), (6, "x"), (6, "x"), (6, "\U0001f600X\u00c9")])
    assert J.contains_join(texts, names.limit(0), text="text", name="name").count() == 0
    assert J.contains_join(texts.limit(0), names, text="text", name="name").count() == 0


def test_contains_join_against_brute_force(spark, monkeypatch):
    """Few letters, so that names of all lengths overlap, share prefixes and recur; slices are far shorter than texts."""
    monkeypatch.setattr(N, "SLICE", 200)
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("aab") for _ in range(n))
    texts = [(i, word(draw.randrange(0, 1500))) for i in range(30)]
    names = [(word(n),) for n in range(1, 40) for _ in range(8)] + [(t[5:305],) for _, t in texts] + [("a" * 20 + word(9),) for _ in range(50)]
    got = {(r.id, r.name) for r in J.contains_join(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(names, "name string"), text="text", name="name").select("id", "name").distinct().collect()}
    assert got == {(i, n) for i, t in texts for (n,) in names if n and n in t}


def test_contains_join_of_many_names_in_long_texts(spark):
    """200,000 names with one prefix against texts of a megabyte; a name is planted at known places."""
    names = spark.range(200_000).select(F.col("id").alias("n"), F.concat(F.lit("https://www.example.com/item/"), F.sha2(F.col("id").cast("string"), 256).substr(1, 16)).alias("name"))
    filler = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(15_000)), lambda k: F.concat(F.sha2((F.col("id") * 100_000 + k).cast("string"), 224), F.lit(" https://www.example.com/item/"))), "")
    planted = F.concat(F.lit("https://www.example.com/item/"), F.sha2((F.col("id") * 1000).cast("string"), 256).substr(1, 16))
    texts = spark.range(16).repartition(8).select("id", F.concat(filler, planted, filler).alias("text"))
    assert texts.agg(F.min(F.length("text"))).first()[0] > 1_000_000
    got = sorted((r.id, r.n) for r in J.contains_join(texts, names, text="text", name="name").select("id", "n").collect())
    assert got == [(i, 1000 * i) for i in range(16)]


def test_ranking(spark):
    rows = spark.createDataFrame([(f"n{k}", "alpha beta" if k < 6 else "alpha") for k in range(9)], "node string, text string")
    hits = R.keyword_hits(rows, node="node", text="text", words=["alpha", "beta"], worth=2.0)
    ranked = R.ranked(hits, query="q", n_words=2)
    order = [r.node for r in R.top(ranked, 9).collect()]
    assert order == sorted([f"n{k}" for k in range(6)], key=lambda n: hashlib.sha256(f"q\0{n}".encode()).hexdigest())
    assert order != [r.node for r in R.top(R.ranked(hits, query="other", n_words=2), 9).collect()]
    assert R.ranked(hits.repartition(3), query="q", n_words=1).count() == 9
    few = ranked.limit(1)
    window = [(r.kind, r.position) for r in R.mixed_window(few, ranked, 5).orderBy("position").collect()]
    assert window == [("claim", 1), ("claim", 2), ("session", 3), ("claim", 4), ("claim", 5)]
    assert {r.kind for r in R.mixed_window(ranked.limit(0), ranked, 4).collect()} == {"claim"}
    detail = spark.createDataFrame([("p", k, "hit" if k < 10 else "other") for k in range(13)], "p string, o int, t string")
    got = [r.detail for r in R.capped_details(detail, parent="p", text="t", order="o", words=["hit"]).orderBy("position").collect()]
    assert len(got) == 9 and got[-1] == "5 more claim(s) in this session: 2 matched but exceeded the 8-claim render cap; 3 did not match the query — recall the session node to expand"
    assert R.running_cap(detail, order=[F.col("o")], size=F.length("t"), max_rows=50, max_size=10).count() == 3


@pytest.fixture(scope="module")
def planted(spark):
    def v(**k):
        return tuple(({"tier": 1, "source": "s", "ingested_at": None} | k).get(n) for n in VERTEX.names)

    rows = [v(vid="scope:main:session:ok", label="Session", scope="main"), v(vid="scope:main:claim:w", label="Claim", scope="main", external=True, tier=1), v(vid="scope:a:claim:z", label="Claim", scope="b", tier=None), v(vid="x", label="Odd"), v(vid="scope:main:exchange:e1", label="Exchange", scope="main", status="answered"), v(vid="scope:main:exchange:e2", label="Exchange", scope="main", status="open"), v(vid="scope:main:source:s1", label="Source", scope="main", content_hash="h1"), v(vid="scope:main:source:s2", label="Source", scope="main", content_hash="")]
    vertices = spark.createDataFrame(rows, VERTEX).withColumn("ingested_at", F.current_timestamp())
    edges = spark.createDataFrame([("CONTAINS", "scope:main:session:ok", "scope:a:claim:z", "Session", "Claim", None), ("NOPE", "a", "b", None, None, None), ("SUPERSEDES", "scope:main:claim:w", "scope:main:source:s1", "Claim", "Source", None), ("RESOLVES", "agent:x", "scope:main:thread:t", "Agent", "Thread", {"basis": "said so"})], EDGE)
    return vertices, edges


def test_contract_finds_each_planted_defect(spark, planted):
    v, e = planted
    blobs = spark.createDataFrame([("h2",)], "hash string")
    got = {(r.rule, r.subject.split(" ")[0]) for r in C.check_graph(v, e, blobs).collect()}
    for want in [("vertex-label", "x"), ("provenance-hole", "scope:a:claim:z"), ("laundered-claim", "scope:main:claim:w"), ("scope-integrity", "scope:a:claim:z"), ("edge-label", "NOPE"), ("edge-ends", "SUPERSEDES"), ("illegal-crossing", "CONTAINS"), ("uncited-close", "RESOLVES"), ("answered-uncited", "scope:main:exchange:e1"), ("orphan", "scope:main:exchange:e1"), ("evidence-lost", "scope:main:source:s1"), ("source-hash", "scope:main:source:s2")]:
        assert want in got, want
    assert ("orphan", "scope:main:exchange:e2") not in got and not any(s == "scope:main:session:ok" for _, s in got)
    assert C.uncited_blobs(v, blobs).count() == 1


def test_knowledge_contract(spark):
    ddl = "batch_id string, scope string, origin string, content_hash string, tier int, entities array<string>, claims array<struct<kind: string, description: string, entities: array<string>>>, chunks array<struct<ordinal: int, text: string, start: int, end: int>>, anchors map<int,int>"
    good = ("good", "lit", "o", "h", 2, ["E"], [("paper/x", "d", ["E"])], [(0, "t", 0, 1)], {0: 0})
    bad = ("bad", "main", "", "", 1, ["orphan"], [("bare", " ", ["undeclared"])], [(0, "", 3, 3), (0, "u", 0, 1)], {4: 9})
    df = spark.createDataFrame([good, bad], ddl)
    got = {(r.batch_id, r.rule) for r in C.check_knowledge(df).withColumnRenamed("subject", "batch_id").collect()}
    assert {b for b, _ in got} == {"bad"} and len({r for _, r in got}) == 12
    narrowed = {r.batch_id: r for r in C.reconcile_entities(df).collect()}
    assert narrowed["bad"].entities == [] and narrowed["good"].entities == ["E"]


def test_ingress_floor_never_raises_trust(spark):
    claims = spark.createDataFrame([("c1", "s", "uses tool calls heavily", 1, False, "own"), ("c2", "s", "entirely different words here", 1, False, "own"), ("c3", "s", "marked by model", 1, True, "own"), ("c4", "s", "tool calls heavily", 3, False, "own")], "claim_id string, session string, description string, tier int, external boolean, source string")
    pages = spark.createDataFrame([("s", "The page says tool-calls are used heavily.")], "session string, text string")
    got = {r.claim_id: (r.tier, r.external) for r in C.ingress_floor(claims, pages).collect()}
    assert got == {"c1": (2, True), "c2": (1, False), "c3": (2, True), "c4": (3, True)}
    assert {r.tier for r in C.ingress_floor(claims, pages, verifiable=False).collect()} == {2, 3}


def test_as_of_without_a_key_in_many_ranges(spark, monkeypatch):
    """Ranges of equal size, ties at their borders, rows before the first and without a time."""
    import random

    monkeypatch.setattr(J, "RANGE_ROWS", 7)
    rng = random.Random(3)
    left = [(k, rng.randrange(40)) for k in range(120)] + [(900, None)]
    right = [(rng.randrange(5, 40), f"v{k:02d}") for k in range(25)] + [(None, "no")]
    want = {k: max(((t2, v) for t2, v in right if t2 is not None and t is not None and t2 <= t), default=(0, "none"))[1] for k, t in left}
    got = J.as_of_join(spark.createDataFrame(left, "id int, t int"), spark.createDataFrame(right, "t2 int, v string"), left_ts="t", right_ts="t2", value="v", default="none").collect()
    assert {r.id: r.v for r in got} == want and len(got) == len(left)


def test_innermost_of_open_and_closed_spans(spark):
    import random
    from datetime import datetime, timedelta

    rng = random.Random(4)
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    spans = [(f"s{k:02d}", rng.choice("ab"), s, None if rng.random() < 0.3 else s + rng.randrange(0, 90)) for k in range(40) for s in [rng.randrange(400)]]
    calls = [(k, rng.choice("ab"), rng.randrange(450)) for k in range(150)]
    want = {c: max(((s, i) for i, r2, s, e in spans if r2 == r and s <= t and (e is None or t <= e)), default=(0, None))[1] for c, r, t in calls}
    df = J.interval_join(spark.createDataFrame([(c, r, at(t)) for c, r, t in calls], "c int, room string, t timestamp"), spark.createDataFrame([(i, r, at(s), None if e is None else at(e)) for i, r, s, e in spans], "i string, room string, s timestamp, e timestamp"), key="room", at="t", start="s", end="e", span_id="i", call_id=["c"])
    assert {r.c: r.i for r in df.collect()} == want


def test_rescue_matches_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(k, rng.choice("xy"), rng.random() < 0.5, sorted({rng.choice("abcde") for _ in range(rng.randrange(0, 4))})) for k in range(80)]
    blocks, passes = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    want = {b[0]: any(p[1] == b[1] and p[0] > b[0] and len(set(p[3]) & set(b[3])) >= min(2, len(b[3])) for p in passes) for b in blocks}
    shape = "pos int, key string, block boolean, prints array<string>"
    got = J.rescued(spark.createDataFrame(blocks, shape), spark.createDataFrame(passes, shape), key="key", pos="pos", prints="prints").collect()
    assert {r.pos: r.rescued for r in got} == want and len(set(want.values())) == 2


def test_innermost_of_long_and_deeply_nested_spans(spark):
    """Ten thousand nested spans of one key, spans of ten years, ends that touch calls, times before 1970."""
    import random
    from datetime import datetime, timedelta

    rng = random.Random(4)
    t0 = datetime(2026, 1, 1)
    spans = [("k", f"n{i:05}", t0 + timedelta(seconds=i), t0 + timedelta(seconds=40_000 - i)) for i in range(10_000)]
    spans += [("k", f"y{i}", t0 - timedelta(days=3650 + i), t0 + timedelta(days=i)) for i in range(20)]
    spans += [("m", f"r{i}", (a := datetime(1969, 6, 1) + timedelta(microseconds=rng.randrange(10**14))), a + timedelta(microseconds=rng.choice([0, 1, 10**6, 10**12]))) for i in range(200)]
    spans += [("m", "bad", t0, t0 - timedelta(days=1)), (None, "none", t0, t0)]
    calls = [(f"a{i}", "k", t0 + timedelta(seconds=rng.randrange(-100, 41_000), microseconds=rng.choice([0, 1]))) for i in range(300)]
    calls += [(f"b{i}", "m", rng.choice(spans[10_020:10_220])[rng.choice([2, 3])] + timedelta(microseconds=rng.choice([-1, 0, 1]))) for i in range(300)]
    calls += [("c", "k", None), ("d", None, t0), ("e", "k", t0 - timedelta(days=3000))]
    got = J.interval_join(spark.createDataFrame(calls, "id string, key string, at timestamp"), spark.createDataFrame(spans, "key string, span string, s timestamp, e timestamp"), key="key", at="at", start="s", end="e", span_id="span", call_id=["id"])
    want = {i: max(((s, n) for k, n, s, e in spans if k == key and key is not None and at is not None and s <= at <= e), default=(None, None))[1] for i, key, at in calls}
    assert {r.id: r.span for r in got.collect()} == want
