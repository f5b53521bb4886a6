"""Reachability, components, lineage and trust over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import crosses_scope
from .iterate import settle


#: Rounds of single steps before a closure doubles its reach each round.
STEPS = 8


def closure(edges: DataFrame, nodes: DataFrame | None = None, *, src: str = "src", dst: str = "dst", max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth) of the reflexive transitive closure with the least depth.

    Semi-naive for the first ``STEPS`` rounds: each joins only the pairs found last
    with the edges. From then on a round doubles the depth: a shortest path of d to
    2d steps begins with one of exactly d steps, so the pairs at depth d meet all
    known ones. Long chains end after a logarithm of their length in rounds. Cycles
    end because no new pair appears. The result is as large as the reachability
    relation itself.
    """
    step = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()
    ends = nodes.select(F.col(nodes.columns[0]).alias("src")) if nodes is not None else step.select("src").unionByName(step.select(F.col("dst").alias("src")))
    known = settle(ends.where("src is not null").distinct().select("src", F.col("src").alias("dst"), F.lit(0).alias("depth")))
    step, delta, depth = settle(step), known, 0
    while max_depth is None or depth < max_depth:
        if depth < STEPS:
            reach = 1
            hop = delta.select("src", F.col("dst").alias("mid"), F.lit(depth).alias("far")).join(step.select(F.col("src").alias("mid"), "dst", F.lit(1).alias("near")), "mid")
        else:
            reach = depth if max_depth is None else min(depth, max_depth - depth)
            hop = known.where(F.col("depth") == depth).select("src", F.col("dst").alias("mid"), F.col("depth").alias("far")).join(known.where(F.col("depth").between(1, reach)).select(F.col("src").alias("mid"), "dst", F.col("depth").alias("near")), "mid")
        found = hop.groupBy("src", "dst").agg(F.min(F.col("far") + F.col("near")).cast("int").alias("depth"))
        delta = settle(found.join(known.select("src", "dst"), ["src", "dst"], "left_anti"))
        depth += reach
        if delta.isEmpty():
            break
        known = known.unionByName(delta)
        if depth >= STEPS:
            known = settle(known)
    return known


def strong_components(reach: DataFrame) -> DataFrame:
    """(node, component, size) of the strongly connected components with more than one member, from a closure."""
    both = reach.alias("a").join(reach.alias("b"), (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src")))
    label = both.groupBy(F.col("a.src").alias("node")).agg(F.min(F.col("a.dst")).alias("component"), F.count("*").alias("size"))
    return label.where("size > 1")


def strong_labels(edges: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node: its strongly connected component, named by its least member; no closure is built.

    Least ids travel along the edges until none changes. What reaches the owner
    of its id back among nodes of that id is the owner's component; edges between
    the other nodes of one id go on to the next round.
    """
    step = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()
    live = step = settle(step)
    found = None
    while True:
        # An edge of a cycle starts where another ends and ends where another starts.
        inner = live.where("src <> dst").join(live.where("src <> dst").select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        live = settle(inner.join(live.where("src <> dst").select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if live.isEmpty():
            break
        own = live.select(F.col("src").alias("node")).unionByName(live.select(F.col("dst").alias("node"))).distinct()
        low = changed = settle(own.withColumn("component", F.col("node")))
        while True:
            offered = changed.select(F.col("node").alias("src"), "component").join(live, "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("given"))
            changed = settle(low.join(offered, "node").where("given < component").select("node", F.col("given").alias("component")))
            if changed.isEmpty():
                break
            low = settle(low.join(changed.select("node", F.col("component").alias("less")), "node", "left").select("node", F.coalesce("less", "component").alias("component")))
        ends = live.join(low.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(low.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
        live = settle(ends.where("a = b").select("src", "dst"))
        done = front = low.where("node = component")
        while not front.isEmpty():
            back = front.select(F.col("node").alias("dst"), "component").join(live, "dst").select(F.col("src").alias("node"), "component").distinct()
            front = settle(back.join(done.select("node"), "node", "left_anti"))
            done = settle(done.unionByName(front))
        found = done if found is None else found.unionByName(done)
        live = settle(live.join(done.select(F.col("node").alias("src")), "src", "left_anti").join(done.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    nodes = step.select(F.col("src").alias("node")).unionByName(step.select(F.col("dst").alias("node"))).distinct()
    if found is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _pointers(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst, stop) of a graph in which every node has one edge at most; a stop has none and points at itself."""
    step = settle(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    twice = step.groupBy("src").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (twice or 0) > 1:
        raise ValueError("chains: a node has more than one edge")
    ends = step.select(F.col("dst").alias("src")).join(step.select("src"), "src", "left_anti").distinct()
    return settle(step.select("src", "dst", F.lit(False).alias("stop")).unionByName(ends.select("src", F.col("src").alias("dst"), F.lit(True).alias("stop"))))


def _jumped(now: DataFrame, **more: Column) -> DataFrame:
    """Pointers that span four times as many steps: two doublings and one write."""

    def hop(now: DataFrame) -> DataFrame:
        far = now.select(F.col("src").alias("dst"), F.col("dst").alias("far"), *[F.col(c).alias(f"far_{c}") for c in more])
        return now.join(far, "dst").select("src", F.col("far").alias("dst"), *[v.alias(c) for c, v in more.items()])

    return settle(hop(hop(now)))


def _ring_labels(nodes: DataFrame) -> DataFrame:
    """(src, ring) of the nodes on rings: nodes that are still reached when further jumps reach no fewer; a ring is named by its least node."""
    jump, size = nodes.select("src", "dst"), None
    while True:
        reached = jump.select("dst").distinct().count()
        if reached == size:
            break
        size, jump = reached, _jumped(jump)
    core = settle(jump.select(F.col("dst").alias("src")).distinct())
    ring = settle(nodes.where("NOT stop").join(core, "src", "left_semi").select("src", "dst", F.least("src", "dst").alias("low")))
    while True:
        wider = _jumped(ring, low=F.least("low", "far_low"))
        same = wider.select("src", F.col("low").alias("new")).join(ring.select("src", "low"), "src").where("new <> low").isEmpty()
        ring = wider
        if same:
            break
    return settle(ring.select("src", F.col("low").alias("ring")))


def chain_rings(edges: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component, size) of the strongly connected components with more than one member, where every node has one
    edge at most: they are the rings that chains end in, found by jumping pointers; no closure is written."""
    ring = _ring_labels(_pointers(edges, src, dst))
    sizes = ring.groupBy("ring").agg(F.count("*").alias("size")).where("size > 1")
    return ring.join(sizes, "ring").select(F.col("src").alias("node"), F.col("ring").alias("component"), "size")


def chain_reach(edges: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, reachable, ring) of a graph in which every node has one edge at most: nodes reached, itself included, and
    the least node of the ring that its chain ends in, or null.

    Pointers jump: a round doubles twice the steps that every pointer spans, so a chain
    of n nodes takes about log4(n) rounds, and no pair of nodes is ever written.
    """
    nodes = _pointers(edges, src, dst)
    ring = _ring_labels(nodes)
    sizes = ring.groupBy("ring").agg(F.count("*").alias("size"))
    # Chains up to their ring or stop: what lies there stays where it is.
    held = nodes.where("stop").select("src").unionByName(ring.select("src"))
    walk = nodes.select("src", "dst").join(held.withColumn("done", F.lit(True)), "src", "left")
    walk = settle(walk.select("src", F.when(F.col("done"), F.col("src")).otherwise(F.col("dst")).alias("dst"), F.when(F.col("done"), 0).otherwise(1).cast("long").alias("steps")))
    while True:
        farther = _jumped(walk, steps=F.col("steps") + F.col("far_steps"))
        same = farther.agg(F.sum("steps")).first()[0] == walk.agg(F.sum("steps")).first()[0]
        walk = farther
        if same:
            break
    out = walk.join(ring.withColumnRenamed("src", "dst"), "dst", "left").join(sizes, "ring", "left")
    return out.select("src", (F.col("steps") + F.coalesce("size", F.lit(1))).alias("reachable"), "ring")


def reach_counts(edges: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, reachable): how many nodes each node reaches, itself included.

    The closure runs over strongly connected components with their sizes, so it
    is as large as the reachability between components, not between nodes.
    """
    label = settle(strong_labels(edges, src=src, dst=dst))
    size = label.groupBy("component").agg(F.count("*").alias("size"))
    a, b = label.select(F.col("node").alias(src), F.col("component").alias("from")), label.select(F.col("node").alias(dst), F.col("component").alias("to"))
    between = edges.select(src, dst).join(a, src).join(b, dst).where("from <> to").select(F.col("from").alias("src"), F.col("to").alias("dst"))
    reach = closure(between, size.select("component"))
    held = reach.join(size.withColumnRenamed("component", "dst"), "dst").groupBy(F.col("src").alias("component")).agg(F.sum("size").alias("reachable"))
    return label.join(held, "component").select(F.col("node").alias("src"), "reachable")


def propagation_cost(reach: DataFrame, n_modules: int) -> DataFrame:
    """One row: pairs (self included), modules, pairs / modules squared."""
    return reach.agg(F.count("*").alias("pairs")).select("pairs", F.lit(n_modules).cast("long").alias("modules"), F.try_divide(F.col("pairs").cast("double"), F.lit(float(n_modules) ** 2)).alias("propagation_cost"))


def fan_in(edges: DataFrame, nodes: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, fan_in) with zero for nodes that nothing points at; repeated edges count once."""
    counts = edges.select(src, dst).distinct().groupBy(F.col(dst).alias("node")).agg(F.count("*").alias("fan_in"))
    return nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().join(counts, "node", "left").select("node", F.coalesce("fan_in", F.lit(0)).cast("long").alias("fan_in"))


def fork_roots(rows: DataFrame, *, node: str, parent: str) -> DataFrame:
    """(node, root): the oldest ancestor inside the set, by pointer jumping.

    A parent outside the set makes a root; the members of a parent cycle all get
    its least member as root.
    """
    own = rows.select(F.col(node).alias("node"), F.col(parent).alias("parent")).where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"))
    inside = own.join(own.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent")
    up = settle(own.select("node").join(inside, "node", "left").select("node", F.coalesce("parent", "node").alias("up"), F.least("node", F.coalesce("parent", "node")).alias("low")))
    # Distances double each round, so after log2(rows) rounds every pointer has reached a root or gone round its cycle.
    for _ in range(max(1, up.count().bit_length() + 1)):
        above = up.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        jumped = settle(up.join(above, "up").select("node", F.col("up2").alias("up"), F.least("low", "low2").alias("low")))
        moved = jumped.select("node", "up", "low").exceptAll(up.select("node", "up", "low"))
        done = moved.isEmpty()
        up = jumped
        if done:
            break
    self_ = up.select(F.col("node").alias("up"), (F.col("up") == F.col("node")).alias("is_root"), F.col("low").alias("up_low"))
    on_root = own.join(inside.select("node").distinct(), "node", "left_anti").select(F.col("node").alias("up"), F.lit(True).alias("true_root"))
    out = up.join(on_root, "up", "left").join(self_, "up")
    return out.select("node", F.when(F.col("true_root"), F.col("up")).otherwise(F.col("up_low")).alias("root"))


def corroboration(rows: DataFrame, *, node: str, parent: str, group: str) -> DataFrame:
    """(group, asserted, independent, corroborated): a group's witnesses, and their distinct roots once forks fall together."""
    joined = rows.select(F.col(group), F.col(node).alias("node")).join(fork_roots(rows, node=node, parent=parent), "node")
    return joined.groupBy(group).agg(F.count("*").alias("asserted"), F.count_distinct("root").alias("independent")).withColumn("corroborated", F.col("independent") > 1)


def unanimous(rows: DataFrame, *, key: str, value: str) -> DataFrame:
    """(key, value, n): the one value on which all rows of a key agree, else an empty string; agreement is least = greatest, so nothing is listed."""
    g = rows.groupBy(key).agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.count("*").alias("n"))
    return g.select(key, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("").alias("value"), "n")


def identity_audit(rows: DataFrame, *, content: str, name: str) -> DataFrame:
    """(content, spellings, projects, names) of contents that stand under several names."""
    g = rows.groupBy(content).agg(F.count("*").alias("spellings"), F.array_sort(F.collect_set(name)).alias("_s"))
    return g.where(F.size("_s") > 1).select(content, "spellings", F.size("_s").cast("long").alias("projects"), F.array_join("_s", ",").alias("names"))


def value_verdicts(rows: DataFrame, *, value: str, confirmed: Column, strong: Column | None = None) -> DataFrame:
    """(value, tested, confirmed, disproved): a value is disproved if it was tested and never confirmed (strongly, where asked)."""
    return rows.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("tested"), F.count_if(confirmed).alias("confirmed"), (~F.bool_or(F.coalesce(confirmed if strong is None else confirmed & strong, F.lit(False)))).alias("disproved"))


def lineage_heads(nodes: DataFrame, supersedes: DataFrame, *, node: str, key: str, at: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """(key, head): of the nodes that nothing supersedes, each key's newest, ties to the greatest id."""
    free = nodes.join(supersedes.select(F.col(dst).alias(node)).distinct(), node, "left_anti")
    return free.groupBy(key).agg(F.max_by(node, F.struct(at, node)).alias("head"))


def trust_floor(nodes: DataFrame, derived: DataFrame, *, node: str = "node", tier: str = "tier", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, effective_tier): the greatest tier over everything a node derives from, itself included.

    Tiers travel against the edges until no row changes; a round carries one row
    for each node that changed, not the whole closure.
    """
    own = nodes.select(F.col(node).alias("node"), F.col(tier).alias("tier"))
    edges = settle(derived.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    state = settle(own)
    changed = state
    while True:
        offered = changed.select(F.col("node").alias("dst"), F.col("tier").alias("given")).join(edges, "dst").groupBy(F.col("src").alias("node")).agg(F.max("given").alias("given"))
        raised = settle(state.join(offered, "node").where("tier is null or given > tier").select("node", F.col("given").alias("tier")))
        if raised.isEmpty():
            return state.select("node", F.col("tier").alias("effective_tier"))
        state = settle(state.join(raised.select("node", F.col("tier").alias("up")), "node", "left").select("node", F.coalesce("up", "tier").alias("tier")))
        changed = raised


def orphans(nodes: DataFrame, edges: DataFrame, *, node: str = "vid", src: str = "src", dst: str = "dst", exempt: Column | None = None) -> DataFrame:
    """Nodes without any edge, but for exempt ones."""
    ends = edges.select(F.col(src).alias(node)).unionByName(edges.select(F.col(dst).alias(node))).distinct()
    alone = nodes.join(ends, node, "left_anti")
    return alone if exempt is None else alone.where(~exempt)


def crossing_edges(edges: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.where(crosses_scope(F.col(src), F.col(dst)))


def connected_components(edges: DataFrame, nodes: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of the undirected graph, component its least node; contracts the graph each round."""
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    live = settle(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    name = settle(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().withColumn("at", F.col("node")))
    while not live.isEmpty():
        least = settle(live.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("from"), F.least("u", "v").alias("to")))
        name = settle(name.join(least, F.col("at") == F.col("from"), "left").select("node", F.coalesce("to", "at").alias("at")))
        moved = live.join(least.select(F.col("from").alias("u"), F.col("to").alias("mu")), "u").join(least.select(F.col("from").alias("v"), F.col("to").alias("mv")), "v")
        live = settle(moved.where("mu <> mv").select(F.col("mu").alias("u"), F.col("mv").alias("v")).distinct())
    low = name.groupBy("at").agg(F.min("node").alias("component"))
    return name.join(low, "at").select("node", "component")


def shortest_paths(edges: DataFrame, start: DataFrame, *, src: str = "src", dst: str = "dst", max_depth: int | None = None) -> DataFrame:
    """(start, node, hops) from each start node along directed edges."""
    step = settle(edges.select(F.col(src).alias("at"), F.col(dst).alias("node")).distinct())
    known = settle(start.select(F.col(start.columns[0]).alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("hops")))
    front, hops = known, 0
    while max_depth is None or hops < max_depth:
        hops += 1
        near = front.select("start", F.col("node").alias("at")).join(step, "at").select("start", "node").distinct()
        front = settle(near.join(known, ["start", "node"], "left_anti").withColumn("hops", F.lit(hops)))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def page_rank(nodes: DataFrame, edges: DataFrame, *, rounds: int = 20, damping: float = 0.85, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, rank) summing to 1; the weight of nodes without out-edges is spread evenly."""
    step = settle(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    degree = step.groupBy("src").agg(F.count("*").alias("degree"))
    all_ = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    n = all_.count()
    if n == 0:
        return all_.withColumn("rank", F.lit(0.0))
    base = settle(all_.join(degree.withColumnRenamed("src", "node"), "node", "left"))
    rank = base.withColumn("rank", F.lit(1.0 / n))
    for k in range(rounds):
        loose = rank.where("degree is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sent = rank.where("degree is not null").select(F.col("node").alias("src"), (F.col("rank") / F.col("degree")).alias("share")).join(step, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("got"))
        rank = base.join(sent, "node", "left").withColumn("rank", F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("got", F.lit(0.0))).drop("got")
        rank = settle(rank)
    return rank.select("node", "rank")


def label_clusters(nodes: DataFrame, edges: DataFrame, *, rounds: int = 10, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, cluster): each round every node takes the most frequent label that its in-neighbours vote for, ties to the least."""
    step = settle(edges.select(F.col(src).alias("src"), F.col(dst).alias("node")).distinct())
    labels = settle(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().withColumn("cluster", F.col("node")))
    for _ in range(rounds):
        votes = labels.select(F.col("node").alias("src"), F.col("cluster").alias("vote")).join(step, "src").groupBy("node", "vote").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.min_by("vote", F.struct(-F.col("n"), F.col("vote"))).alias("vote"))
        following = settle(labels.join(best, "node", "left").select("node", F.coalesce("vote", "cluster").alias("cluster")))
        done = following.exceptAll(labels).isEmpty()
        labels = following
        if done:
            break
    return labels


def neighbours(doomed: DataFrame, edges: DataFrame, *, node: str = "vid", src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes next to doomed ones in either direction that are not doomed themselves, with how many edges they lose."""
    out = edges.join(doomed.select(F.col(node).alias(src)), src, "left_semi").select(F.col(dst).alias(node))
    in_ = edges.join(doomed.select(F.col(node).alias(dst)), dst, "left_semi").select(F.col(src).alias(node))
    return out.unionByName(in_).join(doomed.select(node), node, "left_anti").groupBy(node).agg(F.count("*").alias("lost_edges"))


def counted_dependencies(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, kind), module level before deferred."""
    rank = F.when(F.col("depth") == "module", 0).otherwise(1)
    return edges.groupBy("src", "dst", "kind").agg(F.min_by("depth", rank).alias("depth"))


def metric_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(metric, before, after) of two (metric, value) tables, and null where one lacks it."""
    return old.select("metric", F.col("value").alias("before")).join(new.select("metric", F.col("value").alias("after")), "metric", "full_outer")
