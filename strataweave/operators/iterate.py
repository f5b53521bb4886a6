"""Tables that cut the lineage of loops, in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a new folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found


def settle(df: DataFrame) -> DataFrame:
    """The same rows read back from Parquet: a lost executor repeats no earlier round."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, key: str, buckets: int) -> tuple[str, DataFrame]:
    """Like ``settle``, in buckets of a column: joins by it move the other side only. Also returns the table's name, to be dropped."""
    spark, name = df.sparkSession, f"loop_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/{name}").format("parquet").saveAsTable(name)
    return name, spark.table(name)
