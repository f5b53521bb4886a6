from __future__ import annotations

import ast
import hashlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from strataweave.functions import ids as I
from strataweave.plans import architecture as A
from strataweave.plans import ingest as N
from strataweave.plans import recall as RC
from strataweave.schema import EDGE, VERTEX
from strataweave.sources import documents as D
from strataweave.sources import store as ST


def vertices(spark, *rows):
    return spark.createDataFrame([tuple(({"tier": 1, "source": "s"} | r).get(n) for n in VERTEX.names) for r in rows], VERTEX)


def edges(spark, *rows):
    return spark.createDataFrame([(*r, None, None, None)[:6] if len(r) < 6 else r for r in rows], EDGE)


def test_store_is_idempotent_and_restores(spark, tmp_path):
    s = ST.GraphStore(spark, str(tmp_path / "g"))
    with pytest.raises(ST.GraphUnavailable):
        s.read()
    s.create()
    delta = vertices(spark, {"vid": "scope:main:session:s1", "label": "Session", "scope": "main", "summary": "first"}), edges(spark, ("CONTAINS", "scope:main:session:s1", "scope:main:claim:c"))
    s.write(*delta)
    row = s.snapshot("one", taken_at="t1")
    g = s.write(*delta)
    assert (g.vertices.count(), g.edges.count()) == (1, 1) and s.snapshot("again", taken_at="t2")["digest"] == row["digest"]
    s.write(vertices(spark, {"vid": "scope:main:session:s1", "label": "Session", "scope": "main", "summary": "second"}))
    assert s.read().vertices.first().summary == "second" and s.verify("one")
    assert s.restore("one", taken_at="t3").vertices.first().summary == "first"
    with pytest.raises(ValueError):
        s.snapshot("one", taken_at="t4")
    assert s.remove(s.read().vertices.select("vid")).edges.count() == 0


def test_upsert_rules(spark):
    old = vertices(spark, {"vid": "v", "label": "Source", "tier": 2, "origin": "a", "title": "t"})
    new = vertices(spark, {"vid": "v", "label": "Source", "tier": 1, "origin": "b"}, {"vid": "w", "label": "Source", "tier": 3})
    got = {r.vid: r for r in ST.upsert_vertices(old, new, hold_first=("origin",), never_lower=("tier",)).collect()}
    assert (got["v"].tier, got["v"].origin, got["v"].title, got["w"].tier) == (2, "a", "t", 3)
    assert {r.conflict for r in ST.source_conflicts(old, new).collect()} == {"tier 2 does not rise to 1", "origin stays a"}
    a = edges(spark, ("L", "x", "y", None, None, {"k": "1", "m": "2"}))
    b = edges(spark, ("L", "x", "y", None, None, {"k": "9"}), ("L", "x", "z", None, None, None))
    assert {r.dst: r.props for r in ST.upsert_edges(a, b).collect()} == {"y": {"m": "2", "k": "9"}, "z": None}
    now = F.lit("2026-01-02").cast("timestamp")
    first = ST.stamped(vertices(spark, {"vid": "t", "title": "same"}), vertices(spark), F.col("title"), F.lit("2026-01-01").cast("timestamp"))
    again = {r.vid: r.written_at.day for r in ST.stamped(vertices(spark, {"vid": "t", "title": "same"}), first, F.col("title"), now).collect()}
    changed = ST.stamped(vertices(spark, {"vid": "t", "title": "new"}), first, F.col("title"), now).first()
    assert again == {"t": 1} and changed.written_at.day == 2
    refs = spark.createDataFrame([("s", "th", "resolved"), ("s", "gone", "open")], "session string, thread string, status string")
    update, links = ST.apply_thread_refs(vertices(spark, {"vid": "th", "label": "Thread"}), refs)
    assert update.first().status == "resolved" and [r.label for r in links.collect()] == ["RESOLVES"]


@pytest.mark.parametrize(("size", "overlap"), [(50, 10), (7, 3)])
def test_chunks_cover_the_text(spark, size, overlap):
    text = "lorem ipsum dolor sit amet " * 8 + "x" * 60 + " end"
    spans = list(D.chunk_spans(text, size, overlap))
    assert all(text[a:b] == body and len(body) <= size for _, a, b, body in spans)
    covered = set()
    for _, a, b, _ in spans:
        covered |= set(range(a, b))
    assert all(text[i] == " " for i in range(len(text)) if i not in covered)
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "")], "doc_id int, text string")
    got = D.chunked(df, size=size, overlap=overlap).collect()
    assert [tuple(r)[1:] for r in sorted(got) if r.doc_id == 1] == spans and {r.doc_id for r in got} == {1, 2, 4}


def test_ingest_builds_a_graph(spark):
    body = "The quick brown fox jumps over the lazy dog again and again. " * 6
    sources = spark.createDataFrame([("lit", "h" * 64, body)], "scope string, content_hash string, text string")
    chunks = N.source_chunks(sources, size=120, overlap=20).cache()
    e = N.chunk_edges(chunks)
    assert e.where("label = 'ADJACENT_IN_TEXT'").count() == chunks.count() - 1 and e.where("label = 'DERIVED_FROM'").count() == chunks.count()
    claims = spark.createDataFrame([("c1", "scope:lit:source:" + "h" * 64, "QUICK brown fox jumps over the"), ("c2", "scope:lit:source:" + "h" * 64, "too short")], "claim string, source string, citation string")
    a = N.anchors(chunks, claims).collect()
    assert len(a) == 1 and a[0].dst.endswith("-0000") and body[int(a[0].props["start"]) : int(a[0].props["end"])].lower() == "quick brown fox jumps over the"
    assert N.mentions(chunks, spark.createDataFrame([("Lazy Dog", "lit"), ("absent", "lit")], "name string, scope string")).select("dst").distinct().first().dst == "scope:lit:entity:lazy-dog"
    ddl = "scope string, origin string, content_hash string, tier int, feed string, title string, uri string, entities array<string>, claims array<struct<kind: string, description: string, entities: array<string>>>, chunks array<struct<ordinal: int, text: string, start: int, end: int>>, anchors map<int,int>"
    batch = spark.createDataFrame([("lit", "o", "hh", 2, "f", "T", "u", ["E"], [("p/x", "d.", ["E"])], [(0, "t", 0, 1), (1, "u", 1, 2)], {0: 1})], ddl)
    v, e = N.knowledge_delta(batch, F.current_timestamp())
    assert {r.label: r.n for r in v.groupBy("label").agg(F.count("*").alias("n")).collect()} == {"Source": 1, "Entity": 1, "Claim": 1, "Chunk": 2}
    assert {r.label: r.n for r in e.groupBy("label").agg(F.count("*").alias("n")).collect()} == {"DERIVED_FROM": 3, "ABOUT": 1, "ANCHORS": 1, "ADJACENT_IN_TEXT": 1}
    roots = spark.createDataFrame([("/w/repo",), ("/w",)], "repo_root string")
    paths = spark.createDataFrame([("/w/repo/src/a.py",), ("rel/b.py",)], "identifier string")
    assert [tuple(r) for r in N.projections(paths, roots).collect()] == [("/w/repo/src/a.py", "/w/repo", "src/a.py")]


def test_archive_and_html(spark, tmp_path):
    good = b"token sk-" + b"a" * 40
    name = hashlib.sha256(good).hexdigest()
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab" / name).write_bytes(good)
    (tmp_path / "ab" / ("0" * 64)).write_bytes(b"tampered")
    blobs = D.read_archive(spark, str(tmp_path))
    assert {r.hash: r.intact for r in blobs.collect()} == {name: True, "0" * 64: False}
    assert [(r.hash, r.pattern) for r in D.blob_secrets(blobs).collect()] == [(name, "openai-key")]
    html = spark.createDataFrame([(b"<p>Caf&eacute;</p><nav>menu</nav> &#x41;",), (b"plain  text",), (b"%PDF-1.4",)], "p binary")
    assert [r.t for r in html.select(D.document_text(F.col("p")).alias("t")).collect()] == ["Café A", "plain text", None]
    assert D.repair_yaml('x\n```yaml\ntitle: a: b\n```') == {"title": "a: b"} and D.repair_yaml("- 1") is None


def test_blob_store(spark, tmp_path):
    def make(path, missing=False):
        texts = [b"first", b"second"]
        ids = [hashlib.sha256(t).digest() for t in texts]
        root = b"".join(b"\x0a\x20" + i for i in ids)
        db = sqlite3.connect(path)
        db.execute("CREATE TABLE blobs (id TEXT, data BLOB)")
        db.execute("CREATE TABLE meta (key TEXT, value TEXT)")
        rows = [("root", root), *[(i.hex(), t) for i, t in zip(ids, texts, strict=True)][: 1 if missing else 2]]
        db.executemany("INSERT INTO blobs VALUES (?, ?)", rows)
        db.execute("INSERT INTO meta VALUES ('0', ?)", (json.dumps({"latestRootBlobId": "root"}).encode().hex(),))
        db.commit()
        db.close()

    make(tmp_path / "whole.db")
    make(tmp_path / "part.db", missing=True)
    (tmp_path / "junk.db").write_bytes(b"no database at all")
    got = {r.path.rsplit("/", 1)[1]: (r.verdict, list(r.texts)) for r in D.read_stores(spark, str(tmp_path)).collect()}
    assert got == {"whole.db": ("verified", ["first", "second"]), "part.db": ("incomplete", ["first"]), "junk.db": ("no-store", [])}
    with pytest.raises(ValueError):
        D.root_refs(b"\x0a\x05abc")


def test_architecture(spark):
    files = {"p/a.py": "from p import b\nimport os", "p/b.py": "from . import c", "p/c.py": "def f():\n    import p.a", "p/d.py": "def broken(", "q.py": "x = 1"}
    assert ast.parse(files["p/a.py"])
    src = spark.createDataFrame(list(files.items()), "path string, source string")
    e = D.dependency_edges(src).cache()
    assert {(r.src, r.dst, r.depth) for r in e.collect()} == {("p/a.py", "p/b.py", "module"), ("p/b.py", "p/c.py", "module"), ("p/c.py", "p/a.py", "deferred")}
    m = {r.metric: r["value"] for r in A.measure(src, e).collect()}
    assert m == {"modules": 5, "dependencies": 3, "propagation_cost": 11 / 25, "cycles": 1, "modules_in_cycles": 3}
    found = {(r.category, r.subject) for r in A.findings(src, e, [("low", "p/a*"), ("high", "p/b*"), ("high", "p/c*"), ("none", "zz*")], [("high", "low")]).collect()}
    assert found == {("cycle", "p/a.py p/b.py p/c.py"), ("rule", "p/a.py -> p/b.py"), ("unplaced", "p/d.py"), ("unplaced", "q.py"), ("stale-pattern", "zz*")}
    days = spark.createDataFrame([(f"2026-01-{d:02d}", d * 2) for d in range(1, 20)], "day string, total long").withColumn("day", F.to_date("day"))
    assert {r.span: r.slope for r in A.headline(days).collect()} == {"all": 2.0, "recent": 2.0}


def test_recall_endpoints(spark):
    rows = [
        {"vid": "scope:main:session:s1", "label": "Session", "scope": "main", "session_id": "s1", "summary": "Parser cache work", "project": "demo"},
        {"vid": "scope:main:session:s2", "label": "Session", "scope": "main", "session_id": "s2", "summary": "unrelated", "forked_from": "s1", "project": "demo"},
        {"vid": "scope:main:claim:c1", "label": "Claim", "scope": "main", "kind": "problem", "description": "parser cache grows"},
        {"vid": "scope:main:claim:c2", "label": "Claim", "scope": "main", "kind": "problem", "description": "solved parser cache"},
        {"vid": "scope:main:claim:free", "label": "Claim", "scope": "main", "kind": "x/y", "description": "Cache parser theory"},
        {"vid": "scope:secret:claim:no", "label": "Claim", "scope": "secret", "description": "parser cache secret"},
        {"vid": "artifact:/w/r/a.py", "label": "Artifact", "identifier": "/w/r/a.py", "repo": "r", "path": "a.py"},
        {"vid": "artifact:a.py", "label": "Artifact", "identifier": "a.py", "repo": "r", "path": "a.py"},
        {"vid": "scope:main:exchange:e", "label": "Exchange", "scope": "main", "expert": "lit", "from_scope": "main", "question": "cache?", "status": "open"},
        {"vid": "scope:main:thread:t", "label": "Thread", "scope": "main", "status": "open", "title": "cache thread"},
    ]
    s1, s2, c1, c2 = (f"scope:main:{x}" for x in ("session:s1", "session:s2", "claim:c1", "claim:c2"))
    e = edges(spark, ("CONTAINS", s1, c1), ("CONTAINS", s2, c1), ("CONTAINS", s1, c2), ("SOLVED_BY", c2, c1), ("TOUCHES", c1, "artifact:a.py"))
    r = RC.Recall(ST.Graph(vertices(spark, *rows), e))
    got = r.keyword("the parser cache").collect()
    assert [(x.kind, x.node) for x in sorted(got, key=lambda x: x.position)] == [("claim", "scope:main:claim:free"), ("session", s1), ("session", s2)]
    assert "secret" not in " ".join(x.node for x in got)
    assert {x.vid for x in r.by_artifact("/w/r").collect()} == {s1, s2}
    problems = r.open_problems().collect()
    assert [(p.claim, p.asserted, p.times) for p in problems] == [(c1, 2, 1)]
    assert [x.vid for x in r.exchanges("cache").collect()] == ["scope:main:exchange:e"] and RC.Recall(ST.Graph(vertices(spark, *rows), e), ["other"]).exchange("scope:main:exchange:e").count() == 0
    assert r.open_threads(topic="cache").first()["overlap"] == 1
    brief = {x.node: x.section for x in r.brief("parser cache").collect()}
    assert brief[c1] == "problem" and brief[s1] == "match"
    block = RC.render(r.keyword("parser cache")).where(F.col("node") == s1).first().block
    assert block.startswith("- `scope:main:session:s1` (session)\n> Parser cache work")
    drawn = RC.withhold(r.keyword("parser cache"), rate=1.0, seed="x").collect()
    assert sum(not x.withheld for x in drawn) == 1
    assert I.scope_of is not None


def test_deltas_touch_only_their_buckets_and_merge_in_order(spark, tmp_path):
    from strataweave.schema import EDGE, VERTEX
    from strataweave.sources.store import DeltaStore

    def rows(data, ddl, schema):
        df = spark.createDataFrame(data, ddl)
        return df.select(*[F.col(f.name).cast(f.dataType) for f in schema if f.name in df.columns])

    vertices = lambda data: rows(data, "vid string, label string, title string, tier int, origin string", VERTEX)
    edges = lambda data: rows(data, "label string, src string, dst string, props map<string,string>", EDGE).selectExpr("label", "src", "dst", "CAST(NULL AS STRING) AS src_label", "CAST(NULL AS STRING) AS dst_label", "props").select(*EDGE.names)
    store = DeltaStore(spark, str(tmp_path / "graph"), buckets=16, hold_first=("origin",), never_lower=("tier",))
    assert store.read().vertices.count() == 0
    store.append(vertices([(f"v{k}", "Claim", "t", 1, "") for k in range(200)]), edges([("R", f"v{k}", f"v{k + 1}", {"a": "1"}) for k in range(199)]))
    assert store.compact() == 1 and store._parts() == (1, [])
    # A column that is missing keeps its values; of two rows of one delta the last by the order wins.
    n = store.append(vertices([("v7", "Claim", "new", 0, "web"), ("w", "Claim", "fresh", 2, "x")]).withColumn("at", F.lit(1)).unionByName(vertices([("v7", "Claim", "newest", 3, "other")]).withColumn("at", F.lit(2))), order="at")
    files = [p for p in (tmp_path / "graph" / f"delta-{n}").rglob("part-*.parquet")]
    assert 1 <= len(files) <= 2
    store.append(edges=edges([("R", "v7", "v8", {"b": "2"})]))
    store.append(vertices([("v7", None, None, 2, "late")]), edges([("R", "v7", "v8", {"a": "3"}), ("S", "v7", "w", None)]))
    row = lambda g: tuple(g.vertices.where("vid = 'v7'").select("label", "title", "tier", "origin").first())
    edge = lambda g: g.edges.where("label = 'R' AND src = 'v7'").first().props
    for g in (store.read(), store.read(["v7"])):
        assert row(g) == ("Claim", "newest", 3, "web") and edge(g) == {"a": "3", "b": "2"}
    few = store.read(["v7"])
    assert few.vertices.count() == 1 and few.edges.count() == 2
    before = sorted(map(str, store.read().vertices.collect())), sorted(map(str, store.read().edges.collect()))
    base = store.compact()
    assert store._parts() == (base, []) and (sorted(map(str, store.read().vertices.collect())), sorted(map(str, store.read().edges.collect()))) == before
    # A write without its marker is no write, and its number is used again.
    torn = store.append(vertices([("torn", "Claim", "t", 1, "")]))
    (tmp_path / "graph" / f"delta-{torn}" / "DONE").unlink()
    assert store.read().vertices.where("vid = 'torn'").isEmpty()
    assert store.append(vertices([("whole", "Claim", "t", 1, "")])) == torn
    assert {r.vid for r in store.read().vertices.where("vid IN ('torn', 'whole')").collect()} == {"whole"}
    assert store.vacuum() and store.read().vertices.count() == 202
    store.DELTAS = 2
    store.write(vertices([("more", "Claim", "t", 1, "")]))
    assert store._parts()[1] == [] and store.read().vertices.count() == 203
