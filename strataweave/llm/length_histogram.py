"""Exact length histogram: encoded lengths counted, suffix sums answer every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bpe import token_lengths
from .workspace import Workspace

#: Lengths that share one range of the two-level suffix sum.
RANGE = 64


def length_histogram(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """One row per distinct length: n_tokens, documents, tokens, documents_from, tokens_from, total_to, truncated_total.

    ``documents_from`` and ``tokens_from`` are suffix sums over lengths of
    n_tokens and more; ``total_to`` is the tokens of lengths up to n_tokens, and
    ``truncated_total`` all tokens left when every document is cut at n_tokens.
    Null and empty texts have length 0; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession)
    lengths = token_lengths(docs.select(F.col(text_col).alias("text")), path)
    rows = work.keep(lengths.groupBy("n_tokens").agg(F.count("*").alias("documents")).withColumn("tokens", F.col("n_tokens") * F.col("documents")), "histogram")
    part = F.floor(F.col("n_tokens") / RANGE)
    ranges = rows.groupBy(part.alias("part")).agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    later = W.orderBy(F.col("part").desc()).rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"), F.sum("t").over(W.partitionBy(F.lit(1))).alias("all_tokens"))
    inside = W.partitionBy("part").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("part", part).withColumns({"din": F.sum("documents").over(inside), "tin": F.sum("tokens").over(inside)}).join(ranges, "part")
    out = out.withColumns({"documents_from": F.col("din") + F.col("d"), "tokens_from": F.col("tin") + F.col("t")})
    total_to = F.col("all_tokens") - F.col("tokens_from") + F.col("tokens")
    return out.select("n_tokens", "documents", "tokens", "documents_from", "tokens_from", total_to.alias("total_to"), (total_to + F.col("n_tokens") * (F.col("documents_from") - F.col("documents"))).alias("truncated_total"))


def truncated_totals(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """(context_limit, documents, tokens) for a table of limits: tokens left when texts are cut there, exact for any limit.

    A limit takes the sums of the greatest length that it reaches; the window
    sees one row a distinct length and one a limit.
    """
    kinds = "at long, side int, total_to long, longer long, documents long"
    rows = histogram.selectExpr("n_tokens AS at", "0 AS side", "total_to", "documents_from - documents AS longer", "documents")
    asked = limits.selectExpr("context_limit AS at", "1 AS side", "CAST(NULL AS BIGINT) AS total_to", "CAST(NULL AS BIGINT) AS longer", "0 AS documents")
    cast = [F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in kinds.split(", ")]
    both = rows.select(*cast).unionByName(asked.select(*cast))
    all_ = W.partitionBy(F.lit(1))
    reached = all_.orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumns({"total_to": F.coalesce(F.last("total_to", ignorenulls=True).over(reached), F.lit(0)), "documents": F.sum("documents").over(all_), "longer": F.last("longer", ignorenulls=True).over(reached)})
    tokens = F.col("total_to") + F.col("at") * F.coalesce("longer", "documents")
    return out.where("side = 1").select(F.col("at").alias("context_limit"), "documents", tokens.alias("tokens"))


def length_quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The least length that at least ``share`` of the documents do not exceed, as one row (n_tokens)."""
    total = F.max("documents_from").over(W.partitionBy(F.lit(1)))
    to = total - F.col("documents_from") + F.col("documents")
    return histogram.withColumn("reached", to >= F.lit(share) * total).where("reached").agg(F.min("n_tokens").alias("n_tokens"))
