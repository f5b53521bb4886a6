"""Tables that cut lineage, kept in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a light table that one task writes.
ROWS_PER_FILE = 65_536


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a new folder in local mode and an error on a cluster, whose executors share none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Rows of an Arrow batch, set where the session leaves Spark's 10,000: whole texts travel in it, several copies a worker.
ARROW_ROWS = 2048
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Workspace:
    """One run's intermediate Parquet tables.

    A table written here survives lost executors: a retried task rereads files
    that every executor shares, and nothing upstream of them runs again.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        if spark.conf.get(_ARROW_ROWS) == "10000":
            spark.conf.set(_ARROW_ROWS, ARROW_ROWS)
        self.base = f"{shared_dir(spark)}/strataweave-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, *, rows: int | None = None, per_file: int = ROWS_PER_FILE, compression: str = "snappy") -> DataFrame:
        """Write and read back. Where the number of ``rows`` is known, so many tasks write files of ``per_file`` rows each.

        On a local file system without Hadoop's native library executors start a ``chmod`` process for files and folders they make.
        """
        path = f"{self.base}/{name}"
        (df if rows is None else df.coalesce(1 + rows // per_file)).write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
