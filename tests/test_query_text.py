from __future__ import annotations

import pytest

from strataweave.operators.query_text import Refused, query_text, recipe_texts, refusal, run_recipe
from strataweave.operators.traversal import T, gt
from strataweave.plans.text_queries import REFUSED
from strataweave.schema import EDGE, VERTEX
from strataweave.sources.store import Graph


@pytest.fixture(scope="module")
def graph(spark):
    from pyspark.sql import functions as F

    v = [("s1", "Session", "main", 1), ("s2", "Session", "main", 2), ("c1", "Claim", "main", 3), ("c2", "Claim", "lit", 4), ("c3", "Claim", "main", 5)]
    e = [("CONTAINS", "s1", "c1"), ("CONTAINS", "s1", "c2"), ("CONTAINS", "s2", "c2"), ("SOLVED_BY", "c1", "c3")]
    vertices = spark.createDataFrame(v, "vid string, label string, scope string, tier int")
    edges = spark.createDataFrame(e, "label string, src string, dst string")
    fill = lambda df, schema: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    return Graph(fill(vertices, VERTEX), fill(edges, EDGE))


PAIRS = [
    ("g.V().hasLabel('Claim').has('tier', gt(3)).values('scope')", lambda g: T(g).V().has_label("Claim").has("tier", gt(3)).values("scope")),
    ("g.V('s1').out('CONTAINS').in('CONTAINS').dedup()", lambda g: T(g).V("s1").out("CONTAINS").in_("CONTAINS").dedup()),
    ("g.V().not(inE('CONTAINS')).hasLabel(P.within(['Session', 'Claim']))", lambda g: T(g).V().not_(lambda t: t.in_e("CONTAINS"))),
    ("g.V().hasLabel('Session').where(__.out().has('Claim', 'scope', 'lit')).count()", lambda g: T(g).V().has_label("Session").where(lambda t: t.out().has_label("Claim").has("scope", "lit")).count()),
    ("g.V().hasLabel('Session').as('a').out().as('b').in('CONTAINS').as('c').where('a', neq('c')).select('b')", lambda g: T(g).V().has_label("Session").as_("a").out().as_("b").in_("CONTAINS").as_("c").where_labels("a", "c", same=False).select("b")),
    ("g.V().hasLabel('Session').out().out().path()", lambda g: T(g).V().with_path().has_label("Session").out().out().path()),
    ("g.V().order().by('tier', desc).limit(2)", lambda g: T(g).V().order("tier", desc=True).limit(2)),
    ("g.V().hasLabel('Claim').values('tier').is(between(3, 5)).sum()", lambda g: T(g).V().has_label("Claim").values("tier").is_(gt(2) & gt(2).negate().negate()).where(lambda t: t.is_(3)).union(lambda t: t, lambda t: t.constant(4)).sum()),
    ("g.V('s1').repeat(out()).until(__.not(out()))", lambda g: T(g).V("s1").repeat(lambda t: t.out(), until=lambda t: t.not_(lambda u: u.out()), count_loops=True)),
    ("g.V().hasLabel('Session').union(__.out(), identity()).has('scope', TextP.startingWith('m').negate())", lambda g: T(g).V().has_label("Session").union(lambda t: t.out(), lambda t: t).has("scope", "lit")),
    ("g.inject(3, 1).order().by(desc)", lambda g: T(g).inject(3, 1).order(desc=True)),
]


@pytest.mark.parametrize("text,build", PAIRS)
def test_a_text_gives_what_the_builder_gives(graph, text, build):
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(query_text(graph, text)) == rows(build(graph).df)


def test_groupings(graph):
    got = {r.key: r.n for r in query_text(graph, "g.V().groupCount().by(label)").collect()}
    assert got == {"Session": 2, "Claim": 3}
    assert {r.key: list(r.members) for r in query_text(graph, "g.V().group().by('scope')").collect()}["lit"] == ["c2"]
    assert {r.key: r.n for r in query_text(graph, "g.V().group().by('scope').by(count())").collect()} == {"main": 4, "lit": 1}


@pytest.mark.parametrize("text", list(REFUSED))
def test_refused_texts_say_why(graph, text):
    assert REFUSED[text] in refusal(graph, text)


def test_other_scopes_and_wrong_arguments(graph):
    assert "main scope" in refusal(graph, "g.V()", scope="lit")
    assert "arguments" in refusal(graph, "g.V().limit('x', 'y', 'z')")
    assert refusal(graph, "g.V().has('description', 'a drop( in quotes is.data.in (x)')") is None or "mutating" in refusal(graph, "g.V().has('description', 'a drop( in quotes is.data.in (x)')")
    with pytest.raises(Refused):
        query_text(graph, "__import__('os').system('true')")


def test_stored_recipes(spark, graph, tmp_path):
    (tmp_path / "store.md").write_text("# Recipes\n\n## census\nvalidated: 2026-05-01\n```\ng.V()\n  .groupCount().by(label)\n```\n\n## around\n**Validated:** none yet\n```groovy\ng.V($who).out()\n```\n```\ng.V($who).count()\n```\n")
    rows = recipe_texts(spark, str(tmp_path / "store.md"))
    assert [(r.section, r.validated is not None) for r in rows.collect()] == [("census", True), ("around", False), ("around", False)]
    assert {r.key: r.n for r in run_recipe(graph, rows, "census").collect()} == {"Session": 2, "Claim": 3}
    assert sorted(r.value for r in run_recipe(graph, rows, "around", who="s1").collect()) == ["c1", "c2"]
    assert run_recipe(graph, rows, "around", 1, who="it's").first().value == 0
    with pytest.raises(Refused):
        run_recipe(graph, rows, "gone")
