"""URL filters: rules on host and path, else a path-template tree; native DataFrame operations only.

Urls are first counted by (host, shape), a shape being the path with numbers and
hex strings generalised. The tree, its tests and its leaves work on these counts;
rows meet only the verdict of their shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Labelled rows that a branch needs before it is tested against its siblings.
SUPPORT = 5
#: Standard errors by which a branch's share of bad labels must differ from its siblings' to stay apart.
Z = 2.576
#: A segment with so much of its node is constant and no variable.
CONSTANT = 0.9
#: Rows that the share expected of a template counts for.
PRIOR = 4.0
PURITY = 0.5
#: A shape with more than a thousandth of all rows is joined by broadcast; there are under a thousand of them.
HOT_SHARE = 1000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is (host/path, verdict)."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    """A segment with its digits generalised: numbers, hex strings and mixed names become wildcards."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(segment.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("{hex}"))
        .when(segment.rlike("[0-9]"), F.regexp_replace(segment, "[0-9]+", "{n}"))
        .otherwise(segment)
    )


def templates(shapes: DataFrame, work: Workspace, *, support: int = SUPPORT, z: float = Z) -> DataFrame:
    """Adds ``template`` to counted shapes (host, shape, n, seen, bad): the path with variable segments as wildcards.

    Level by level under each (host, template so far), a segment stays literal if
    it holds ``CONSTANT`` of its node, or if it has ``support`` labelled rows or
    more and its share of bad ones differs from that of its siblings together by
    more than ``z`` standard errors; branches that do not differ merge into ``*``.
    A level reads only shapes that have a further segment, and the tree ends where
    none has. A node of fewer than ``support`` rows is not split: what is left of
    its shapes leaves as wildcards.
    """
    parts = F.split(F.regexp_replace("shape", "^/", ""), "/")
    tree = work.keep(shapes.withColumns({"parts": parts, "template": F.lit("")}).withColumn("left", F.size("parts")), "tree-0")
    ended, level = [tree.where("left <= 0")], 0
    while not (rows := tree.where("left > 0")).isEmpty():
        rows = rows.withColumn("seg", F.try_element_at("parts", F.lit(level + 1)))
        child = rows.groupBy("host", "template", "seg").agg(F.sum("n").alias("c_n"), F.sum("seen").alias("c_seen"), F.sum("bad").alias("c_bad"))
        child = work.keep(child, f"children-{level}")
        node = child.groupBy("host", "template").agg(F.sum("c_n").alias("n_n"), F.sum("c_seen").alias("n_seen"), F.sum("c_bad").alias("n_bad"))
        others, others_bad = F.col("n_seen") - F.col("c_seen"), F.col("n_bad") - F.col("c_bad")
        pooled = (F.col("n_bad") + 0.5) / (F.col("n_seen") + 1)
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest("c_seen", F.lit(1)) + 1 / F.greatest(others, F.lit(1))))
        gap = F.abs(F.col("c_bad") / F.greatest("c_seen", F.lit(1)) - others_bad / F.greatest(others, F.lit(1)))
        differs = (F.col("c_seen") >= support) & (others > 0) & (gap > z * error)
        stays = differs | (F.col("c_n") >= CONSTANT * F.col("n_n"))
        told = child.join(node, ["host", "template"]).select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("seg").alias("_s"), (F.col("n_n") >= support).alias("split"), stays.alias("stays"))
        told = work.keep(told, f"told-{level}")
        joined = rows.join(told, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (F.col("seg") == F.col("_s")))
        piece = F.when(F.col("split"), F.concat(F.lit("/"), F.when(F.col("stays"), F.col("seg")).otherwise("*"))).otherwise(F.repeat(F.lit("/*"), F.col("left")))
        left = F.when(F.col("split"), F.col("left") - 1).otherwise(F.lit(0))
        level += 1
        tree = work.keep(joined.withColumns({"template": F.concat("template", piece), "left": left}).drop("_h", "_t", "_s", "split", "stays", "seg"), f"tree-{level}")
        ended.append(tree.where("left <= 0"))
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return out.drop("parts", "left")


def domain_of(host: Column) -> Column:
    """The host without its first name, if two are left."""
    return F.regexp_replace(host, r"^[^.]+\.(?=[^.]+\.[^.])", "")


def judged(tree: DataFrame, work: Workspace, *, prior: float = PRIOR) -> DataFrame:
    """(host, template, bad_share): smoothed shares of bad labels.

    A template without many labels falls back on what is expected of it: the
    share of its host, which falls back on its domain and that on all rows, moved
    by how much its shapes deviate from all rows across hosts.
    """
    totals = tree.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("seen"), F.lit(0)).alias("seen")).first()
    overall = F.lit((totals["bad"] or 0) / max(1, totals["seen"] or 0))
    share = lambda bad, seen, expected: (bad + prior * expected) / (seen + prior)
    by = lambda *keys: tree.groupBy(*keys).agg(F.sum("bad").alias("b"), F.sum("seen").alias("s"))
    domains = by(domain_of(F.col("host")).alias("domain")).select("domain", share(F.col("b"), F.col("s"), overall).alias("domain_share"))
    hosts = by("host").withColumn("domain", domain_of(F.col("host"))).join(domains, "domain").select("host", share(F.col("b"), F.col("s"), F.col("domain_share")).alias("host_share"))
    across = by("shape").select("shape", share(F.col("b"), F.col("s"), overall).alias("shape_share"))
    leaf = tree.join(across, "shape").groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("seen").alias("s"), (F.sum(F.col("n") * F.col("shape_share")) / F.sum("n")).alias("shape_share"))
    expected = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("host_share") + F.col("shape_share") - overall))
    return work.keep(leaf.join(hosts, "host").select("host", "template", share(F.col("b"), F.col("s"), expected).alias("bad_share")), "judged")


def filter_urls(urls: DataFrame, rules: list[tuple[str, str]], *, url_col: str = "url", bad_col: str = "bad", prior: float = PRIOR, purity: float = PURITY) -> DataFrame:
    """The input's columns plus host, path, rule, verdict, template, bad_share; one row per input row.

    ``bad_col`` is a nullable boolean label. Rules win over the tree. Otherwise a
    url is blocked if its template's smoothed share of bad labels reaches
    ``purity``; no labels at all allow everything. Null or unparsable urls have
    empty host and path and are judged as that host; very long paths are urls like
    others. Repeated rows count each and are judged alike. Input columns with the
    names of outputs are replaced; an empty table gives no rows.
    """
    work = Workspace(urls.sparkSession)
    outputs = ["host", "path", "rule", "verdict", "template", "bad_share"]
    url = F.col(f"_in.{url_col}").cast("string")
    base = urls.select(F.struct(*[F.col(c) for c in urls.columns]).alias("_in"))
    base = base.select("_in", host_of(url).alias("host"), path_of(url).alias("path"), F.col(f"_in.{bad_col}").alias("label"))
    shape = F.array_join(F.transform(F.split("path", "/"), _shape), "/")
    base = work.keep(base.withColumn("shape", shape), "urls")
    counts = base.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("seen"), F.count_if("label").alias("bad"))
    tree = work.keep(templates(work.keep(counts, "shapes"), work), "templates")
    total = base.count()
    known = tree.join(judged(tree, work, prior=prior), ["host", "template"], "left")
    known = work.keep(known.select(F.col("host").alias("_h"), F.col("shape").alias("_s"), "template", "bad_share", (F.col("n") * HOT_SHARE > total).alias("hot")), "known")
    same = (F.col("host") == F.col("_h")) & (F.col("shape") == F.col("_s"))
    large = F.broadcast(known.where("hot"))
    out = base.join(large, same).unionByName(base.join(large.select("_h", "_s"), same, "left_anti").join(known.where("NOT hot"), same, "left"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(says, F.when(F.col("bad_share") >= purity, F.lit("block")).otherwise(F.lit("allow")))
    own = [F.col(f"_in.{c}").alias(c) for c in urls.columns if c not in outputs or c in (url_col, bad_col)]
    return out.select(*own, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", "bad_share")
