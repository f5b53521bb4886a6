from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strataweave.operators import graph as G
from strataweave.operators import traversal as TR
from strataweave.plans.recipes import RECIPES
from strataweave.schema import EDGE, VERTEX
from strataweave.sources.store import Graph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_closure_and_rings(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    reach = G.closure(e)
    assert {(r.src, r.dst) for r in reach.collect() if r.src == "d"} == {("d", "d")}
    assert {(r.node, r.component, r["size"]) for r in G.strong_components(reach).collect()} == {(x, "a", 3) for x in "abc"}
    assert G.propagation_cost(reach, 4).first().propagation_cost == 13 / 16
    assert {(r.dst, r.depth) for r in G.closure(e, max_depth=1).where("src = 'b'").collect()} == {("b", 0), ("c", 1)}


def test_fork_roots(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("x", "y"), ("y", "x"), ("z", "y")], "node string, parent string")
    got = {r.node: r.root for r in G.fork_roots(rows, node="node", parent="parent").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "x": "x", "y": "x", "z": "x"}


def test_trust_floor_follows_cycles(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 3), ("d", 0)], "node string, tier int")
    got = {r.node: r.effective_tier for r in G.trust_floor(nodes, edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("d", "d")])).collect()}
    assert got == {"a": 3, "b": 3, "c": 3, "d": 0}


def test_components_paths_and_rank(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("x", "y")])
    nodes = spark.createDataFrame([(c,) for c in "abcxyz"], "node string")
    assert {r.node: r.component for r in G.connected_components(e, nodes).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    start = spark.createDataFrame([("a",)], "start string")
    assert {(r.node, r.hops) for r in G.shortest_paths(e, start).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    rank = {r.node: r["rank"] for r in G.page_rank(nodes, e, rounds=10).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank["c"] > rank["b"] > rank["a"]
    assert {r.node: r.cluster for r in G.label_clusters(nodes, e).collect()}["c"] == "a"
    assert {r.vid for r in G.orphans(nodes.withColumnRenamed("node", "vid"), e).collect()} == {"z"}


def test_heads_and_neighbours(spark):
    nodes = spark.createDataFrame([("s1", "k", 1), ("s2", "k", 2), ("s3", "k", 3)], "vid string, key string, at int")
    assert G.lineage_heads(nodes, edges(spark, [("s2", "s3")]), node="vid", key="key", at="at").first().head == "s2"
    doomed = spark.createDataFrame([("b",)], "vid string")
    assert {(r.vid, r.lost_edges) for r in G.neighbours(doomed, edges(spark, [("a", "b"), ("b", "c"), ("a", "b")])).collect()} == {("a", 2), ("c", 1)}


@pytest.fixture(scope="module")
def graph(spark):
    rows = [
        {"vid": "scope:main:session:s1", "label": "Session", "scope": "main", "session_id": "s1", "summary": "fix parser cache"},
        {"vid": "scope:main:claim:c1", "label": "Claim", "scope": "main", "kind": "problem", "description": "Parser cache grows"},
        {"vid": "scope:main:claim:c2", "label": "Claim", "scope": "main", "kind": "solution", "description": "Bound it"},
        {"vid": "scope:main:thread:t1", "label": "Thread", "scope": "main", "status": "open", "title": "caches"},
        {"vid": "scope:lit:claim:k1", "label": "Claim", "scope": "lit", "kind": "paper/x", "description": "Cache theory"},
        {"vid": "scope:lit:source:d1", "label": "Source", "scope": "lit", "title": "A paper"},
        {"vid": "artifact:src/a.py", "label": "Artifact", "identifier": "src/a.py"},
    ]
    v = spark.createDataFrame([tuple(r.get(n) for n in VERTEX.names) for r in rows], VERTEX)
    s, c1, c2 = "scope:main:session:s1", "scope:main:claim:c1", "scope:main:claim:c2"
    e = spark.createDataFrame(
        [("CONTAINS", s, c1, "Session", "Claim", None), ("CONTAINS", s, c2, "Session", "Claim", None), ("SOLVED_BY", c1, c2, "Claim", "Claim", None), ("SPAWNS", s, "scope:main:thread:t1", "Session", "Thread", None), ("TOUCHES", c1, "artifact:src/a.py", "Claim", "Artifact", {"anchors": "m1,m2"}), ("DERIVED_FROM", "scope:lit:claim:k1", "scope:lit:source:d1", "Claim", "Source", None)],
        EDGE,
    )
    return Graph(v, e)


def test_traversal_steps(graph):
    t = TR.T(graph)
    assert sorted(t.V().has_label("Claim").values("kind").to_list()) == ["paper/x", "problem", "solution"]
    assert t.V("scope:main:session:s1").out("CONTAINS").out("SOLVED_BY").values("description").to_list() == ["Bound it"]
    assert t.V().has("scope", "main").count().to_list() == [4]
    assert t.V().has_label("Claim").not_(lambda x: x.in_("CONTAINS")).to_list() == ["scope:lit:claim:k1"]
    assert t.V().has_label("Artifact").in_e("TOUCHES").has("anchors", TR.containing("m2")).out_v().values("kind").to_list() == ["problem"]
    assert t.V().has_label("Session").with_path().out("CONTAINS").out("SOLVED_BY").simple_path().path().to_list() == [["scope:main:session:s1", "scope:main:claim:c1", "scope:main:claim:c2"]]
    assert t.V("scope:main:session:s1").repeat(lambda x: x.out(), until=lambda x: x.has_label("Artifact")).to_list() == ["artifact:src/a.py"]
    pairs = t.V().has_label("Session").as_("s").match(("s", lambda x: x.out("CONTAINS"), "a"), ("a", lambda x: x.out("SOLVED_BY"), "b")).select("a", "b").to_list()
    assert [(p.a, p.b) for p in pairs] == [("scope:main:claim:c1", "scope:main:claim:c2")]
    assert t.inject(1, 2, 3).is_(TR.gt(1)).sum().to_list() == [5]
    assert t.inject("a b", "c").split(" ").unfold().fold().to_list() == [["a", "b", "c"]]
    assert sorted(t.V().has_label("Claim").optional(lambda x: x.out("SOLVED_BY")).values("kind").to_list()) == ["paper/x", "solution", "solution"]


def test_counting_nothing_in_a_filter(graph):
    t = TR.T(graph)
    assert t.V().not_(lambda x: x.both_e()).to_list() == []
    lonely = Graph(graph.vertices, graph.edges.where("label <> 'SPAWNS'"))
    assert TR.T(lonely).V().not_(lambda x: x.both_e()).to_list() == ["scope:main:thread:t1"]


def test_bulk_keeps_plans_small(graph):
    """Walks are counted by places: five hops from one vertex never list the walks."""
    t = TR.T(graph).V()
    for _ in range(5):
        t = t.both()
    assert t.count().to_list()[0] > 20


def test_query_guard():
    assert TR.refuse_query("g.V().count()") is None
    assert "drop" in TR.refuse_query("g . V().Drop()")
    assert TR.refuse_query("V()") and TR.refuse_query("g." + "x" * 3000)


def test_every_recipe_runs(graph):
    extra = {"recent_sessions": ["main"], "claims_mentioning": ["CACHE"], "scope_census": ["2030-01-01"], "answered_by": ["lit"], "taken_part": ["lit"], "session_subgraph": ["scope:main:session:s1"], "thread_lifecycle": ["scope:main:thread:t1"], "provenance_walk": ["scope:lit:claim:k1"], "artifact_history": ["a.py"], "paper_contribution": ["scope:lit:source:d1"], "tool_examples": ["main"]}
    got = {n: f(graph, *extra.get(n, [])).collect() for n, f in RECIPES.items()}
    assert len(got) == 23
    assert got["claims_mentioning"][0].value == 2
    assert {r.key: r.n for r in got["graph_census"]} == {"Session": 1, "Claim": 3, "Thread": 1, "Source": 1, "Artifact": 1}
    assert {(r["key"], r.n) for r in got["sessionless_claims"]} == {("paper/x", 1)}
    assert got["artifact_history"][0].touched_by == ["scope:main:claim:c1"]
    assert got["cold_sources"][0].returns == 0


def test_order_of_input_does_not_matter(graph):
    a = G.closure(graph.edges.repartition(5, F.rand(1))).orderBy("src", "dst").collect()
    b = G.closure(graph.edges.repartition(2, F.rand(2))).orderBy("src", "dst").collect()
    assert a == b


def test_whole_part_graph(spark, tmp_path):
    """Orders beyond key 1000, parts beyond 400 and sources off the multiples of three all count."""
    import random

    from strataweave.plans.witness import QUERIES

    rng = random.Random(4)
    lines = [(k, n, rng.randrange(2000, 2020) if k % 2 else rng.choice([2100 + k, 2101 + k])) for k in range(994, 1012) for n in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = {(lines[i][2], lines[i + 1][2]) for i in range(len(lines) - 1) if lines[i][0] == lines[i + 1][0] and lines[i][2] != lines[i + 1][2]}
    nodes = {x for p in pairs for x in p}

    def reached(start, both=False):
        seen, front = {start: 0}, [start]
        for x in front:
            for a, b in pairs:
                for u, v in ((a, b), (b, a)) if both else ((a, b),):
                    if u == x and v not in seen:
                        seen[v] = seen[x] + 1
                        front.append(v)
        return seen

    reach = {x: reached(x) for x in nodes}
    rows = {n: QUERIES[n](spark, str(tmp_path)).collect() for n in ("closure_reach_whole", "scc_groups_whole", "propagation_cost_whole", "connected_parts", "shortest_hops", "fan_in_out")}
    assert {r.src: r.reachable for r in rows["closure_reach_whole"]} == {x: len(reach[x]) for x in nodes}
    ring = {x: [y for y in reach[x] if x in reach[y]] for x in nodes}
    assert {r.node: (r.component, r["size"]) for r in rows["scc_groups_whole"]} == {x: (min(ys), len(ys)) for x, ys in ring.items() if len(ys) > 1}
    assert len({len(ys) for ys in ring.values()}) > 1
    assert (rows["propagation_cost_whole"][0].pairs, rows["propagation_cost_whole"][0].modules) == (sum(map(len, reach.values())), len(nodes))
    assert {r.node: r.component for r in rows["connected_parts"]} == {x: min(reached(x, both=True)) for x in nodes}
    assert {(r.start, r.node): r.hops for r in rows["shortest_hops"]} == {(min(a for a, _ in pairs), y): h for y, h in reach[min(a for a, _ in pairs)].items()}
    assert {r.node: (r.fan_in, r.fan_out) for r in rows["fan_in_out"]} == {x: (sum(b == x for _, b in pairs), sum(a == x for a, _ in pairs)) for x in nodes}


def chain(spark, n):
    v = spark.createDataFrame([tuple({"vid": f"n{k:03d}", "label": "Thread", "title": f"t{k}"}.get(c) for c in VERTEX.names) for k in range(n)], VERTEX)
    e = spark.createDataFrame([("BLOCKS", f"n{k:03d}", f"n{k + 1:03d}", "Thread", "Thread", {"w": str(k)}) for k in range(n - 1)], EDGE)
    return Graph(v, e)


def test_repeat_goes_on_until_no_row_is_left(spark):
    t = TR.T(chain(spark, 41))
    assert t.V("n000").repeat(lambda x: x.out(), until=lambda x: x.has_id("n040")).to_list() == ["n040"]
    with pytest.raises(RuntimeError, match="still walking"):
        t.V("n000").repeat(lambda x: x.out(), until=lambda x: x.has_id("n040"), max_loops=2)
    assert t.V("n030").repeat(lambda x: x.out(), until=lambda x: x.has_id("n040"), count_loops=True).loops().to_list() == [10]
    assert sorted(t.V("n036").repeat(lambda x: x.out(), times=3, emit=True).to_list()) == ["n037", "n038", "n039"]


def test_counting_zero(spark, graph):
    """A place from which nothing is reached counts zero, in a filter and in a local walk."""
    t = TR.T(graph)
    assert t.V().has_label("Claim").where(lambda x: x.in_("CONTAINS").count().is_(0)).to_list() == ["scope:lit:claim:k1"]
    assert sorted(t.V().has_label("Claim").local(lambda x: x.out("SOLVED_BY").count()).to_list()) == [0, 0, 1]
    assert sorted(map(len, t.V().has_label("Claim").local(lambda x: x.out("TOUCHES").fold()).to_list())) == [0, 0, 1]
    assert t.V().has_label("Thread").where(lambda x: x.out().count().is_(TR.gt(0))).to_list() == []


def test_slices_cut_bulk_and_do_not_spread_it(spark):
    t = TR.T(chain(spark, 6)).V("n002")
    for _ in range(4):
        t = t.both()
    values = t.order().to_list()
    assert len(values) == 13 and len(values) > len(set(values))
    ordered = t.order()
    for a, b in ((0, 3), (2, 9), (5, 5), (0, 100), (12, 20)):
        assert ordered.range_(a, b).to_list() == values[a:b]
    for n in (0, 1, 4, 7, 14, 50):
        assert ordered.skip(n).to_list() == values[n:]
        assert ordered.limit(n).to_list() == values[:n]
    assert t.tail(3).to_list() == values[-3:] and t.to_list(limit=5).__len__() == 5
    huge = t._next(t.frame.withColumn("bulk", F.lit(1 << 40).cast("long")))
    assert huge.order().limit(1 << 33).count().to_list() == [1 << 33] and len(huge.sample(7).to_list()) == 7
    picked = [t.sample(5, seed=s).to_list() for s in range(30)]
    assert all(len(p) == 5 for p in picked) and len({tuple(sorted(p)) for p in picked}) > 3
    kept = sum(len(t.coin(0.5, seed=s).to_list()) for s in range(20))
    assert 90 < kept < 190 and t.coin(0.3, 4).to_list() == t.coin(0.3, 4).to_list()


def test_branches_side_effects_and_properties(graph, spark):
    t, held = TR.T(graph), {}
    s = "scope:main:session:s1"
    kinds = t.V().has_label("Claim").choose_option("kind", {"problem": lambda x: x.out("SOLVED_BY"), "solution": lambda x: x.in_("SOLVED_BY")})
    assert sorted(kinds.to_list()) == ["scope:lit:claim:k1", "scope:main:claim:c1", "scope:main:claim:c2"]
    assert t.V(s).out("CONTAINS").aggregate(held, "x").out("SOLVED_BY").aggregate(held, "x").to_list() == ["scope:main:claim:c2"]
    assert {(r.value, r.bulk) for r in t.cap(held, "x").collect()} == {("scope:main:claim:c1", 1), ("scope:main:claim:c2", 2)}
    sub = t.E().has("label", "CONTAINS").subgraph()
    assert sub.vertices.count() == 3 and sub.edges.count() == 2
    tree = t.V(s).with_path().out().out().tree()
    assert {(r.depth, r.node, r.n) for r in tree.collect()} == {(0, s, 2), (1, "scope:main:claim:c1", 2), (2, "scope:main:claim:c2", 1), (2, "artifact:src/a.py", 1)}
    props = t.V("scope:lit:claim:k1").properties("kind", "description", "title")
    assert sorted(props.key().to_list()) == ["description", "kind"] and props.has_key("kind").value().to_list() == ["paper/x"]
    assert props.has_value("Cache theory").element().label().to_list() == ["Claim"]
    assert t.V().has_label("Artifact").in_e("TOUCHES").properties().value().to_list() == ["m1,m2"]
    assert t.V("scope:lit:claim:k1").property_map("kind").to_list()[0]["kind"]["value"] == "paper/x"
    assert t.V("scope:main:claim:c2").as_("a").both_e("SOLVED_BY").other_v("a").to_list() == ["scope:main:claim:c1"]
    assert t.V(s).to_e("out", "CONTAINS").to_v("in").order_by(("kind", True), (None, False)).values("kind").to_list() == ["solution", "problem"]
    assert t.inject("b a b", "c").split(" ").dedup_local().order_local().limit_local(1).unfold().to_list() == ["a", "c"]
    assert t.inject(3, 1).fold().count_local().to_list() == [2] and t.inject(3.0, 1.0).fold().mean_local().to_list() == [2.0]
    two = t.V(s).as_("s").out("CONTAINS").as_("c")
    assert len(two.dedup("s").to_list()) == 1 and len(two.dedup("s", "c").to_list()) == 2
    assert t.V(s).discard().to_list() == []
    with pytest.raises(Exception, match="stop here"):
        t.V(s).fail("stop here").to_list()


def test_closure_doubles_and_stays_exact(spark, monkeypatch):
    """A chain of 40 into a ring: least depths whatever the depth at which doubling begins, and under a bound."""
    pairs = [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(40)] + [("n40", "n33"), ("n05", "n25")]
    nxt = {}
    for a, b in pairs:
        nxt.setdefault(a, []).append(b)
    want = {}
    for s in {x for p in pairs for x in p}:
        depth, front = {s: 0}, [s]
        while front:
            front = [y for x in front for y in nxt.get(x, []) if depth.setdefault(y, depth[x] + 1) == depth[x] + 1 and y not in front]
        want |= {(s, d): k for d, k in depth.items()}
    e = edges(spark, pairs)
    monkeypatch.setattr(G, "STEPS", 2)
    assert {(r.src, r.dst): r.depth for r in G.closure(e).collect()} == want
    assert {(r.src, r.dst): r.depth for r in G.closure(e, max_depth=13).collect()} == {k: v for k, v in want.items() if v <= 13}


def test_chains_and_rings_by_jumping_pointers(spark, monkeypatch):
    import random

    rng = random.Random(9)
    n = 400
    after = {k: rng.randrange(n) for k in range(n) if rng.random() < 0.97}
    after |= {1000 + k: 1001 + k for k in range(700)} | {5000: 5000, 5001: 5000, 6000: 6001, 6001: 6000}
    got = {r.src: (r.reachable, r.ring) for r in G.chain_reach(spark.createDataFrame(list(after.items()), "src long, dst long")).collect()}
    want = {}
    for start in set(after) | set(after.values()):
        seen, at = [], start
        while at not in seen:
            seen.append(at)
            if at not in after:
                break
            at = after[at]
        want[start] = (len(seen), min(seen[seen.index(at) :]) if at in after else None)
    assert got == want
    with pytest.raises(ValueError):
        G.chain_reach(spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long"))


def test_a_chain_of_a_hundred_thousand_takes_few_rounds(spark, monkeypatch):
    rounds = []
    settle = G.settle
    monkeypatch.setattr(G, "settle", lambda df: rounds.append(1) or settle(df))
    chain = spark.range(100_000).selectExpr("id AS src", "id + 1 AS dst")
    out = G.chain_reach(chain).selectExpr("count(*) AS n", "max(reachable) AS far", "sum(reachable) AS pairs").first()
    assert (out.n, out.far, out.pairs) == (100_001, 100_001, 100_001 * 100_002 // 2) and len(rounds) < 45


@pytest.fixture
def followers(spark, tmp_path):
    """A folder whose lineitem has parts of 600 in a row that end in a ring of 5, and a ring of 3 apart."""
    after = {k: k + 1 for k in range(604)} | {604: 600, 1000: 1001, 1001: 1002, 1002: 1000}
    lines = [(a, n, p) for a, b in after.items() for n, p in enumerate((a, b))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def rows_written(monkeypatch):
    """Rows of each table that the graph loops write from now on."""
    rows, settle = [], G.settle

    def counted(df):
        out = settle(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(G, "settle", counted)
    return rows


def test_propagation_cost_writes_no_pairs(spark, followers, monkeypatch):
    from strataweave.plans.witness import QUERIES

    rows = rows_written(monkeypatch)
    out = QUERIES["propagation_cost"](spark, followers).first()
    pairs = sum(605 - k for k in range(600)) + 5 * 5 + 3 * 3
    assert (out.pairs, out.modules, out.propagation_cost) == (pairs, 608, pairs / 608**2)
    assert max(rows) <= 608


def test_propagation_cost_of_nothing(spark, tmp_path):
    from strataweave.plans.witness import QUERIES

    spark.createDataFrame([], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES["propagation_cost"](spark, str(tmp_path)).first()
    assert (out.pairs, out.modules) == (0, 0) and out.propagation_cost != out.propagation_cost  # NaN, as in SQL


def test_scc_groups_writes_no_pairs(spark, followers, monkeypatch):
    from strataweave.plans.witness import QUERIES

    rows = rows_written(monkeypatch)
    out = {r.node: (r.component, r["size"]) for r in QUERIES["scc_groups"](spark, followers).collect()}
    assert out == {k: (600, 5) for k in range(600, 605)} | {k: (1000, 3) for k in (1000, 1001, 1002)}
    assert max(rows) <= 608


def test_traversal_repeat_takes_few_rounds(spark, tmp_path, monkeypatch):
    """A customer with 400 orders takes no 400 rounds, and the orders are put in sequence once."""
    from pyspark.sql import types as ST

    from strataweave.plans.witness import QUERIES

    rows = [(k, c, k % 7) for c, n in ((1, 400), (2, 1), (3, 2), (4, 30)) for k in range(c * 1000, c * 1000 + n)]
    frame = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, day int")
    frame.select("o_orderkey", "o_custkey", F.timestamp_seconds(F.col("day") * 86_400).cast(ST.TimestampNTZType()).alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(TR, "WALK", 2, raising=False)
    monkeypatch.setattr(TR, "WALK_ON", 3, raising=False)
    rounds, settle = [], TR.settle
    monkeypatch.setattr(TR, "settle", lambda df: rounds.append(1) or settle(df))
    got = {(r.value, r.loops) for r in QUERIES["traversal_repeat"](spark, str(tmp_path)).collect()}
    last = {c: max((k % 7, k) for k, d, _ in rows if d == c)[1] for c in (1, 3, 4)}
    assert got == {(f"o{last[1]}", 399), (f"o{last[3]}", 1), (f"o{last[4]}", 29)} and len(rounds) < 60


@pytest.mark.parametrize("branching", [False, True])
def test_repeat_over_a_table_of_steps_is_the_plain_walk(spark, monkeypatch, branching):
    import random
    from collections import Counter

    rng = random.Random(branching)
    n, name, every = 70, "n{:03d}".format, 11 if branching else 45
    pairs = [(k, k + d) for k in range(n) for d in (rng.choices(range(1, 9), k=rng.randrange(4)) if branching else [2]) if k + d < n and (k, d) != (24, 2)]
    kind = {k: "Claim" if k in (50, 51) or branching and k % 4 == 0 else "Thread" for k in range(n)}
    v = spark.createDataFrame([tuple({"vid": name(k), "label": kind[k]}.get(c) for c in VERTEX.names) for k in range(n)], VERTEX)
    e = spark.createDataFrame([("BLOCKS", name(a), name(b), "Thread", "Thread", None) for a, b in pairs] + [("OTHER", name(0), name(k), "Thread", "Thread", None) for k in range(n)], EDGE)
    met = {b for _, b in pairs if b % every == 0 or all(a != b for a, _ in pairs)}
    want, front, loops = Counter(), Counter({k: 1 for k in range(20)}), 0
    while front:
        loops, moved = loops + 1, Counter()
        for a, b in pairs:
            if kind[b] == "Thread" or branching:
                moved[b] += front[a]
        want.update({(name(k), loops): c for k, c in moved.items() if c and k in met})
        front = Counter({k: c for k, c in moved.items() if c and k not in met})
    until = lambda x: x.or_(lambda y: y.not_(lambda z: z.out("BLOCKS")), lambda y: y.has_id(*[name(k) for k in range(0, n, every)]))
    sub = (lambda x: x.out("BLOCKS")) if branching else (lambda x: x.out("BLOCKS").has_label("Thread"))
    start = TR.T(Graph(v, e)).V(*[name(k) for k in range(20)])
    for walk in (0, 3):
        monkeypatch.setattr(TR, "WALK", walk)
        monkeypatch.setattr(TR, "WALK_ON", 2)
        got = start.repeat(sub, until=until, count_loops=True).frame.groupBy("cur", "loops").agg(F.sum("bulk").alias("n")).collect()
        assert {(r.cur, r.loops): r.n for r in got} == want
    assert max(k for _, k in want) > (5 if branching else 15) and (max(want.values()) > 1) == branching


def test_which_walks_go_over_a_table_of_steps(spark, monkeypatch):
    assert TR._only_hop(lambda x: x.has_label("Thread").in_("BLOCKS").where(lambda y: y.out().count().is_(1))) == "in_"
    for walk in (lambda x: x.out().out(), lambda x: x.out().limit(3), lambda x: x.out().dedup(), lambda x: x.out().where(lambda y: y.out().sample(1)), lambda x: x.out()._next(x.frame), lambda x: x.out().aggregate({}, "x"), lambda x: x.repeat(lambda y: y.out(), times=2)):
        assert TR._only_hop(walk) is None
    assert TR._by_place(lambda x: x.not_(lambda y: y.out())) and not TR._by_place(lambda x: x.not_(lambda y: y.out().limit(1)))
    monkeypatch.setattr(TR, "WALK", 1)
    t = TR.T(chain(spark, 12))
    with pytest.raises(RuntimeError, match="still walking"):
        t.V("n000").repeat(lambda x: x.out(), until=lambda x: x.has_id("n011"), max_loops=4)
    assert t.V("n011").repeat(lambda x: x.in_(), until=lambda x: x.has_id("n000"), max_loops=11).to_list() == ["n000"]
    assert t.V("n003").repeat(lambda x: x.out(), until=lambda x: x.has_id("n000")).to_list() == []
