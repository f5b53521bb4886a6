"""Read-only traversal texts, such as ``g.V().hasLabel('Claim').out('SOLVED_BY').count()``, as builder plans.

There is no parser here: a text is a chain of calls, which Python's own ``ast``
reads; nothing is evaluated. Each call is looked up among the allowed steps and
made on the builder, so a text and the same steps written in Python are one plan.
What is not on the list is refused with its reason.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Graph
from . import traversal as tr
from .traversal import P, T, refuse_query

#: Steps whose arguments are plain values or predicates, passed on as they are.
PLAIN = {
    "V", "E", "out", "in_", "both", "outE", "inE", "bothE", "outV", "inV", "bothV", "hasNot", "hasLabel", "hasId", "hasKey", "hasValue", "has", "is_", "values",
    "properties", "propertyMap", "elementMap", "valueMap", "key", "value", "element", "id", "label", "identity", "constant", "fold", "unfold", "simplePath", "cyclicPath",
    "path", "dedup", "limit", "skip", "tail", "range", "coin", "sample", "select", "as_", "inject", "index", "reverse", "toLower", "toUpper", "trim", "lTrim", "rTrim",
    "length", "concat", "split", "replace", "substring", "asString", "asNumber", "asBool", "asDate", "loops", "discard", "count", "sum", "min", "max", "mean", "subgraph",
}
#: Steps whose arguments are walks.
WALKS = {"where", "filter", "not_", "and_", "or_", "union", "coalesce", "optional", "local", "branch"}
#: Steps that work on each list by itself when ``local`` comes first.
LOCAL = {"count", "sum", "min", "max", "mean", "limit", "range", "tail", "dedup", "order"}
MODULATORS = {"by", "times", "until", "emit", "option"}
PREDICATES = {
    "eq": tr.eq, "neq": tr.neq, "lt": tr.lt, "lte": tr.lte, "gt": tr.gt, "gte": tr.gte, "inside": tr.inside, "outside": tr.outside, "between": tr.between, "within": tr.within,
    "without": tr.without, "containing": tr.containing, "startingWith": tr.starting_with, "endingWith": tr.ending_with, "regex": tr.matching,
}
#: Words of the query language that stand for themselves or for a value.
WORDS = {"true": True, "false": False, "null": None, "none": "none", "desc": "desc", "asc": "asc", "local": "local", "id": "id", "label": "label"}
_QUOTED = re.compile(r"('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")")
_KEYWORD = re.compile(r"(?<![\w'\"])(in|is|as|not|and|or)\s*\(")


class Refused(ValueError):
    """A text that is no read-only traversal of the allowed steps; the message says why."""


class Walk:
    """An anonymous traversal: steps to make on whatever it starts from."""

    def __init__(self, steps: list[tuple[str, list]]):
        self.steps = steps

    def __call__(self, t: T) -> T:
        return _walked(t, self.steps)


def _chain(node: ast.expr) -> tuple[ast.expr, list[tuple[str, ast.Call]]]:
    steps = []
    while isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
        steps.append((node.func.attr, node))
        node = node.func.value
    return node, steps[::-1]


class Labels:
    """``eq`` or ``neq`` with a label, as the second argument of ``where``."""

    def __init__(self, label: str, same: bool):
        self.label, self.same = label, same


def _steps(calls: list[tuple[str, ast.Call]]) -> list[tuple[str, list]]:
    out = []
    for name, call in calls:
        if call.keywords:
            raise Refused(f"{name.rstrip('_')}: arguments have no names")
        args = [_argument(a) for a in call.args]
        match call.args:
            case [ast.Constant(value=str()), ast.Call(func=ast.Name(id="eq" | "neq" as test) | ast.Attribute(value=ast.Name(id="P"), attr="eq" | "neq" as test), args=[ast.Constant(value=str(label))])] if name == "where":
                args = [args[0], Labels(label, test == "eq")]
        out.append((name, args))
    return out


def _argument(node: ast.expr):
    """A constant, a list of them, a predicate, or a walk."""
    match node:
        case ast.Constant(value=value) if isinstance(value, str | int | float | bool) or value is None:
            return value
        case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=value)) if isinstance(value, int | float):
            return -value
        case ast.List(elts=elts):
            return [_argument(e) for e in elts]
        case ast.Name(id=name) if name in WORDS:
            return WORDS[name]
        case ast.Attribute(value=ast.Name(id="T" | "Order" | "Scope" | "Pick"), attr=name) if name in WORDS:
            return WORDS[name]
    root, calls = _chain(node)
    match root:
        case ast.Name(id="__") if calls:
            return Walk(_steps(calls))
        case ast.Name(id="P" | "TextP") if calls:
            return _predicate(calls)
        case ast.Call(func=ast.Name(id=name)) if name in PREDICATES:
            return _predicate([(name, root), *calls])
        case ast.Call(func=ast.Name(id=name)):
            return Walk(_steps([(name, root), *calls]))
    raise Refused(f"not a value, predicate or walk: {ast.unparse(node)[:80]}")


def _predicate(calls: list[tuple[str, ast.Call]]) -> P:
    (name, args), *more = _steps(calls)
    if name not in PREDICATES:
        raise Refused(f"unknown predicate {name}")
    args = args[0] if name in ("within", "without") and len(args) == 1 and isinstance(args[0], list) else args
    out = PREDICATES[name](*args)
    for name, args in more:
        if name == "negate":
            out = out.negate()
        elif name in ("and_", "or_") and len(args) == 1 and isinstance(args[0], P):
            out = out & args[0] if name == "and_" else out | args[0]
        else:
            raise Refused(f"unknown predicate {name}")
    return out


def _method(name: str) -> str:
    snake = re.sub(r"([A-Z])", lambda m: f"_{m[1].lower()}", name) if name not in ("V", "E") else name
    return snake if hasattr(T, snake) else f"{snake}_"


def _need(given: bool, why: str) -> None:
    if not given:
        raise Refused(why)


def _step(t, name: str, args: list, mods: list[tuple[str, list]]):
    """One step with what modulates it."""
    _need(isinstance(t, T), f"{name.rstrip('_')} stands behind a step that ends the traversal")
    by = [a for m, a in mods if m == "by"]
    others = {m for m, _ in mods}
    if name in LOCAL and args[:1] == ["local"]:
        return getattr(t, f"{_method(name).rstrip('_')}_local")(*args[1:])
    if name == "where" and len(args) == 2 and isinstance(args[1], Labels):
        return t.where_labels(args[0], args[1].label, same=args[1].same)
    if name in ("order", "group", "groupCount", "project", "select", "valueMap", "elementMap", "dedup", "sample") and by or name in ("order", "groupCount", "group", "project"):
        return _by(t, name, args, by)
    if name == "repeat":
        _need(len(args) == 1 and isinstance(args[0], Walk) and others <= {"times", "until", "emit"}, "repeat takes a walk, then times, until or emit")
        mod = dict(mods)
        _need(bool({"times", "until"} & others), "repeat needs times or until")
        return t.repeat(args[0], times=mod["times"][0] if "times" in mod else None, until=mod["until"][0] if "until" in mod else None, emit="emit" in mod, count_loops=True)
    if name == "choose":
        if "option" in others:
            key = args[0].steps[0][1][0] if isinstance(args[0], Walk) and args[0].steps[0][0] == "values" else args[0]
            options = [a for m, a in mods if m == "option"]
            return t.choose_option(key, {k: w for k, w in options if k != "none"}, next((w for k, w in options if k == "none"), None))
        _need(2 <= len(args) <= 3 and all(isinstance(a, Walk) for a in args), "choose takes walks")
        return t.choose(*args)
    _need(not mods, f"{name.rstrip('_')} takes no {'/'.join(sorted(others))}")
    if name == "match":
        return _matched(t, args)
    if name in WALKS:
        _need(bool(args) and all(isinstance(a, Walk) for a in args), f"{name.rstrip('_')} takes walks")
        return getattr(t, _method(name))(*args)
    _need(name in PLAIN, f"unknown or refused step {name.rstrip('_')}")
    _need(not any(isinstance(a, Walk) for a in args), f"{name.rstrip('_')} takes no walk")
    if name in ("hasLabel", "hasId") and len(args) == 1 and isinstance(args[0], P):
        return t.has("label" if name == "hasLabel" else "id", args[0])
    if name == "has" and len(args) == 3:
        return t.has_label(args[0]).has(*args[1:])
    _need(name not in ("valueMap", "elementMap") or bool(args), f"{name} needs the names of properties")
    return getattr(t, _method(name))(*args)


def _by(t: T, name: str, args: list, by: list[list]):
    keys = [a for a in by if not (len(a) == 1 and isinstance(a[0], Walk))]
    if name == "order":
        orders = [(None if not a or a[0] in ("asc", "desc") else a[0], bool(a) and a[-1] == "desc") for a in by] or [(None, False)]
        _need(len(keys) == len(by) and all(k is None or isinstance(k, str) for k, _ in orders), "order goes by properties")
        return t.order_by(*orders)
    if name == "groupCount":
        _need(len(by) == len(keys) <= 1, "groupCount goes by one property")
        return t.group_count(by[0][0] if by and by[0] else None)
    if name == "group":
        _need(bool(keys) and len(keys[0]) == 1 and len(by) <= 2, "group goes by one property")
        if len(by) == 2:
            _need(isinstance(by[1][0], Walk) and [s[0] for s in by[1][0].steps] == ["count"], "groups hold their members or their count")
            return t.group_count(keys[0][0])
        return t.group(keys[0][0])
    if name == "project":
        _need(len(args) == len(keys) == len(by) > 0 and all(len(a) == 1 for a in keys), "project takes one property for each name")
        return t.project(**{n: a[0] for n, a in zip(args, keys, strict=True)})
    if name == "sample":
        return t.sample(*args, by=keys[0][0])
    raise Refused(f"{name} takes no by")


def _matched(t: T, args: list) -> T:
    patterns = []
    for w in args:
        _need(isinstance(w, Walk) and len(w.steps) >= 3 and w.steps[0][0] == w.steps[-1][0] == "as_", "match takes walks from one label to another")
        patterns.append((w.steps[0][1][0], Walk(w.steps[1:-1]), w.steps[-1][1][0]))
    _need(bool(patterns), "match takes walks from one label to another")
    return t.as_(patterns[0][0]).match(*patterns)


def _walked(t, steps: list[tuple[str, list]]):
    k = 0
    while k < len(steps):
        name, args = steps[k]
        _need(name not in MODULATORS, f"{name} stands behind no step that it modulates")
        k += 1
        mods = []
        while k < len(steps) and steps[k][0] in MODULATORS:
            mods.append(steps[k])
            k += 1
        t = _step(t, name, args, mods)
    return t


def query_text(graph: Graph, text: str, *, scope: str = "main") -> DataFrame:
    """The rows of a traversal text: (value, bulk) and what the walk carries, or (key, n) and the like of a grouping.

    Only the main scope may ask: a free traversal cannot be confined to another one.
    Nothing runs until the result is used, but for ``repeat``, which settles its rounds.
    """
    _need(scope == "main", f"memory_query needs the main scope, not {scope}; ask through a consultation ticket")
    why = refuse_query(text)
    _need(why is None, why or "")
    parts = _QUOTED.split(text.strip())
    plain = "".join(p if k % 2 else _KEYWORD.sub(r"\1_(", p) for k, p in enumerate(parts))
    try:
        tree = ast.parse(plain, mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        raise Refused(f"not a chain of steps: {error}") from error
    root, calls = _chain(tree)
    _need(isinstance(root, ast.Name) and root.id == "g" and bool(calls), "Query must be a traversal that starts with g.")
    steps = _steps(calls)
    _need(steps[0][0] in ("V", "E", "inject"), "a traversal starts with V, E or inject")
    names = {n for n, _ in calls}
    if names & {"path", "simplePath", "cyclicPath"} or re.search(r"\.(path|simplePath|cyclicPath)\(", plain):
        out = _walked(_walked(T(graph), steps[:1]).with_path(), steps[1:])
    else:
        out = _walked(T(graph), steps)
    if isinstance(out, Graph):
        return out.edges
    return out.df if isinstance(out, T) else out


def refusal(graph: Graph, text: str, *, scope: str = "main") -> str | None:
    """Why a text is refused, or None."""
    try:
        query_text(graph, text, scope=scope)
    except Refused as why:
        return str(why)
    except (TypeError, AttributeError, KeyError, IndexError, ValueError) as why:
        return f"a step does not take these arguments: {why}"
    return None


def recipe_texts(spark: SparkSession, path: str) -> DataFrame:
    """(section, text, validated) of a Markdown store of recipes: a heading of level two, a date after ``validated``, fenced texts."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^## ")).alias("part"))
    section, fence = F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)), r"(?s)```[a-z]*\n(.*?)```"
    rows = whole.select(section.alias("section"), F.explode(F.regexp_extract_all("part", F.lit(fence), 1)).alias("text"), F.regexp_extract("part", r"(?i)validated:?\**\s*(\d{4}-\d{2}-\d{2})", 1).alias("on"))
    return rows.select("section", F.trim("text").alias("text"), F.try_to_date(F.nullif("on", F.lit(""))).alias("validated"))


def run_recipe(graph: Graph, recipes: DataFrame, section: str, n: int = 0, **values: str) -> DataFrame:
    """Run the n-th text of a section; ``$name`` stands for a value, which is put in as a quoted text."""
    rows = recipes.where(F.col("section") == section).select("text").collect()
    _need(len(rows) > n, f"no recipe {section!r}")
    quoted: Callable[[re.Match], str] = lambda m: repr(values[m[1]]) if m[1] in values else m[0]
    return query_text(graph, re.sub(r"\$(\w+)", quoted, " ".join(rows[n][0].split())))
