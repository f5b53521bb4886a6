"""Ceremony and close ledgers in file order: indices, arms, outcomes, findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.ledgers import place

# The ledger's vocabulary.
KINDS = ("open", "review", "acceptance", "retrospective", "close")
EVENTS = ("assigned", "start", "end", "skipped", "deliverable", "revision", "commitment", "resolution", "comparator")
OUTCOMES = ("appeared", "absent", "superseded")
ARMS = ("solo", "ticket")


def occasion_indices(rows: DataFrame) -> DataFrame:
    """Started and skipped occasions numbered from 1 within their room and kind."""
    w = W.partitionBy("room", "ceremony_kind").orderBy("path", "line_no")
    return rows.where("event IN ('start', 'skipped')").withColumn("index", F.row_number().over(w))


def next_index(rows: DataFrame) -> DataFrame:
    return rows.where("event IN ('start', 'skipped')").groupBy("room", "ceremony_kind").agg((F.count("*") + 1).alias("next_index"))


def deliverable_history(rows: DataFrame) -> DataFrame:
    """(deliverable_id, outcomes in order, last arm)."""
    r = rows.where("deliverable_id IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("path", "line_no", "outcome")))
    return r.groupBy("deliverable_id").agg(F.filter(F.transform(ordered, lambda x: x["outcome"]), lambda x: x.isNotNull()).alias("outcomes"), F.max_by("arm", F.when(F.col("arm").isNotNull(), place())).alias("arm"))


def draw(units: DataFrame, arms: list[tuple[str, int]], seed: str, *, unit: str = "unit") -> DataFrame:
    """(unit, arm): a seeded order of the units dealt to arms of given sizes; units beyond the arms get null.

    Only as many units as the arms hold are numbered, after a top-k cut that needs
    no sort of all units.
    """
    every = units.select(unit).distinct()
    by = [F.sha2(F.concat(F.lit(seed), F.lit("\u0000"), F.col(unit)), 256), F.col(unit)]
    first = every.orderBy(*by).limit(sum(size for _, size in arms))
    numbered = first.withColumn("_n", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*by)))
    arm, low = F.lit(None).cast("string"), 0
    for name, size in arms:
        arm = F.when((F.col("_n") > low) & (F.col("_n") <= low + size), F.lit(name)).otherwise(arm)
        low += size
    dealt = numbered.select(F.col(unit).alias("_unit"), arm.alias("arm"))
    return every.join(dealt, F.col(unit) == F.col("_unit"), "left").select(unit, "arm")


def assignment_space(counts: list[int]) -> int:
    """How many assignments a draw of these sizes chooses between."""
    from math import factorial

    return reduce(lambda a, n: a // factorial(n), counts, factorial(sum(counts)))


def audit(rows: DataFrame) -> DataFrame:
    """(finding, subject) over one ordered ledger. An occasion that is not ended is no defect; acknowledged findings stay in the report."""
    at = lambda event, also=None: F.min(F.when((F.col("event") == event) & (F.lit(True) if also is None else also), place()))
    o = rows.where("occasion_id IS NOT NULL").groupBy("occasion_id").agg(at("start").alias("started"), at("end").alias("ended"), at("assigned").alias("assigned"), F.count_if(F.col("event") == "start").alias("starts"), F.count_if(F.col("event") == "end").alias("ends"))
    d = rows.where("deliverable_id IS NOT NULL").groupBy("deliverable_id").agg(at("commitment").alias("committed"), at("resolution").alias("resolved"), at("comparator").alias("compared"), F.count_if(F.col("event") == "resolution").alias("resolutions"), F.count_if((F.col("event") == "resolution") & ~F.coalesce(F.col("outcome").isin(list(OUTCOMES)), F.lit(False))).alias("odd"), F.count_if((F.col("event") == "resolution") & (F.coalesce("evidence", F.lit("")) == "")).alias("bare"))
    live = o
    found = [
        ("ended without start", live.where("ended IS NOT NULL AND started IS NULL").select(F.col("occasion_id").alias("s"))),
        ("ended before start", live.where("ended < started").select(F.col("occasion_id").alias("s"))),
        ("started twice", live.where("starts > 1").select(F.col("occasion_id").alias("s"))),
        ("ended twice", live.where("ends > 1").select(F.col("occasion_id").alias("s"))),
        ("assigned after start", live.where("assigned > started").select(F.col("occasion_id").alias("s"))),
        ("resolved without commitment", d.where("resolved IS NOT NULL AND committed IS NULL").select(F.col("deliverable_id").alias("s"))),
        ("resolved before commitment", d.where("resolved < committed").select(F.col("deliverable_id").alias("s"))),
        ("compared after resolution", d.where("compared > resolved").select(F.col("deliverable_id").alias("s"))),
        ("unknown outcome", d.where("odd > 0").select(F.col("deliverable_id").alias("s"))),
        ("outcome without evidence", d.where("bare > 0").select(F.col("deliverable_id").alias("s"))),
    ]
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("finding"), F.col("s").alias("subject")) for name, df in found])


def unacknowledged(findings: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Findings that no acknowledgement names as ``finding:subject``."""
    name = F.concat_ws(":", F.regexp_replace("finding", " ", "-"), "subject")
    return findings.join(acknowledgements.select(F.col("finding").alias("_f")), name == F.col("_f"), "left_anti")


def refused_acknowledgements(findings: DataFrame, asked: DataFrame) -> DataFrame:
    """(finding, why): acknowledgements (finding, reason) without a reason, or of what the audit does not report now."""
    live = findings.select(F.concat_ws(":", F.regexp_replace("finding", " ", "-"), "subject").alias("finding")).distinct()
    bare = asked.where(F.coalesce(F.trim("reason"), F.lit("")) == "").select("finding", F.lit("no reason").alias("why"))
    return bare.unionByName(asked.join(live, "finding", "left_anti").select("finding", F.lit("not a current finding").alias("why")))


def refused_rows(rows: DataFrame) -> DataFrame:
    """(rule, subject, detail): rows with an event, kind, outcome or arm outside the vocabulary, and resolutions without evidence."""
    def rule(where, name: str, detail: str) -> DataFrame:
        return rows.where(where).select(F.lit(name).alias("rule"), F.coalesce("deliverable_id", "occasion_id").alias("subject"), F.coalesce(F.col(detail).cast("string"), F.lit("none")).alias("detail"))

    outside = lambda c, names: ~F.coalesce(F.col(c).isin(list(names)), F.lit(False))
    resolution = F.col("event") == "resolution"
    parts = [
        rule(outside("event", EVENTS), "unknown-event", "event"),
        rule(F.col("ceremony_kind").isNotNull() & outside("ceremony_kind", KINDS), "unknown-kind", "ceremony_kind"),
        rule(F.col("arm").isNotNull() & outside("arm", ARMS), "unknown-arm", "arm"),
        rule(resolution & outside("outcome", OUTCOMES), "unknown-outcome", "outcome"),
        rule(resolution & (F.coalesce(F.trim("evidence"), F.lit("")) == ""), "no-evidence", "evidence"),
    ]
    return reduce(DataFrame.unionByName, parts)


def open_commitments(rows: DataFrame) -> DataFrame:
    return rows.where("event = 'commitment'").join(rows.where("event = 'resolution'").select("deliverable_id").distinct(), "deliverable_id", "left_anti")


def agent_closes(edges: DataFrame, closes: DataFrame) -> DataFrame:
    """RESOLVES edges of agents whose approval the close ledger does not hold."""
    e = edges.where("label = 'RESOLVES' AND src_label = 'Agent'").withColumn("ref", F.try_element_at("props", F.lit("approval_ref")))
    return e.join(closes.where("event = 'approved'").select("ref").distinct(), "ref", "left_anti")
