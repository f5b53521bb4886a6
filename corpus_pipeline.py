"""A corpus pipeline of five of the operators, each stage's result written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import bpe, line_dedup, mixing, near_dedup, quality
from strataweave.llm.queries import good_labels, vocabulary_path
from strataweave.llm.workspace import Workspace, fresh, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; without usable labels all stay.

    Null and empty texts are judged as empty ones, long texts whole. Ids may be null, repeated
    or texts: equal rows share their fate, a score equal to the threshold stays. An empty table stays empty.
    """
    return quality.keep_good(docs, quality.train(docs, good_labels(spark, sf_dir)))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in the one with the greatest id; n_chars follows the text.

    A null text becomes empty. Rows with a null id lose nothing; rows that repeat an id are one document
    and lose the same lines. Long texts are read whole; further columns stay as they are; no rows give none.
    """
    out = line_dedup.dedup_lines(docs, threshold=3, least_chars=20, carry=True)
    kind = dict(docs.dtypes)
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(kind.get("n_chars", "long"))}
    return out.select(*[(changed[c] if c in changed else F.col("input").getField(c)).alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group stays: five-word shingles, similarity of 0.8 or more.

    Texts without words (null, empty) stay. A row is named by its id and its text: rows that repeat an id with
    another text are documents of their own, rows equal in both stay or go together, and a null id is less than
    any other. Long texts are compared whole; further columns stay as they are; no rows give none.
    """
    name = fresh("name", docs.columns)
    named = docs.withColumn(name, F.struct(F.col("doc_id"), F.xxhash64("text").alias("text")))
    gone = near_dedup.near_duplicates(named, width=5, percent=80, id_col=name).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return named.join(gone, named[name] == gone["gone"], "left_anti").drop(name)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, also without an id or with one that repeats.

    Rows without words have size 0 and no copies; a null source is a source of its own. Rows equal in id and
    text tie and are alike; further columns stay as they are; no rows give none.
    """
    mixed = mixing.mix(docs, carry=True).where("copies > 0").select("input", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("turn"))
    return mixed.select("input.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the digest of the text that they decode to.

    A null text has no tokens and decodes to an empty one. Ids repeat where the mix repeats them; other columns go.
    """
    out = bpe.round_trip(docs.select("doc_id", "source", "lang", "text"), vocabulary_path())
    return out.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: The classifier, the shingle links and the tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
