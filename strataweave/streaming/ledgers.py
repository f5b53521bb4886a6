"""Incremental ledgers on Structured Streaming: taps, landing, live state, windows.

Late data is never dropped for being late: landing is an upsert by content id, and
what has no counterpart yet stays visible as pending. Watermarks bound state only
where a result closes by time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LEDGERS
from ..sources.ledgers import parse_time
from .tail import TailSource


def tap_stream(spark: SparkSession, name: str, folder: str, *, files_per_trigger: int = 64) -> DataFrame:
    """A ledger's folder as a stream of new files; rows get their event time as ``at``.

    A file is read once, when it appears: writers rotate files and never append to
    one that is already there.
    """
    rows = spark.readStream.schema(_schema(spark, LEDGERS[name])).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return rows.withColumn("at", parse_time(F.col("ts")) if "ts" in rows.columns else F.current_timestamp())


def _schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def tail_stream(spark: SparkSession, name: str, folder: str, *, glob: str = "*.jsonl", **options: str) -> DataFrame:
    """A ledger whose files grow, as a stream of its rows; bad lines go. ``at`` is the event time, (path, start) a row's place."""
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("tail").options(path=folder, glob=glob, **options).load()
    rows = lines.select(F.from_json("value", LEDGERS[name]).alias("r"), "path", "start").where("r IS NOT NULL").select("r.*", "path", "start")
    return rows.withColumn("at", parse_time(F.col("ts")) if "ts" in rows.columns else F.current_timestamp())


#: Buckets of landed rows.
BUCKETS = 256


def landed_in(spark: SparkSession, target: str, buckets: list[int], *, but: int | None = None) -> DataFrame | None:
    """Landed rows of these buckets, whose folders are the only ones that are listed and read; None if there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [f"{target}/bucket={b}" for b in buckets if fs.exists(path(f"{target}/bucket={b}"))]
    if not there:
        return None
    rows = spark.read.option("basePath", target).parquet(*there)
    return rows if but is None else rows.where(F.col("number") != but)


def land(stream: DataFrame, target: str, checkpoint: str, *, key: str):
    """Write each content id once, whatever is delivered again: a batch is anti-joined to what has landed.

    Rows lie in folders by a bucket of their key, then by batch. A batch lists and
    reads only the buckets that its own keys fall into, and of them the key column;
    it writes one file for each. A batch that runs again replaces what it wrote.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).persist()
        try:
            touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())
            landed = landed_in(spark, target, touched, but=number)
            new = fresh if landed is None else fresh.join(landed.select("bucket", key), ["bucket", key], "left_anti")
            new = new.withColumn("number", F.lit(number)).repartition("bucket")
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "number").parquet(target)
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_landed(spark: SparkSession, target: str, to: str) -> DataFrame:
    """All landed rows under a new folder, one file a bucket; the next query lands there once it is complete."""
    rows = spark.read.parquet(target).withColumn("number", F.lit(-1))
    rows.repartition("bucket").write.partitionBy("bucket", "number").parquet(to)
    return spark.read.parquet(to)


def pending(events: DataFrame, landed: DataFrame, *, key: str) -> DataFrame:
    """What the tap holds and nothing has landed yet."""
    return events.join(landed.select(key), key, "left_anti")


def last_rows(stream: DataFrame, *, key: str, value: str, order: str) -> DataFrame:
    """The last value of each key so far (update mode)."""
    return stream.groupBy(key).agg(F.max_by(value, order).alias(value))


def once_each(stream: DataFrame, *keys: str, at: str = "at", delay: str = "1 day") -> DataFrame:
    """The first row for each combination within the delay, as a throttle."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def tumbling(stream: DataFrame, *keys: str, length: str = "1 day", at: str = "at", delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, length).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding(stream: DataFrame, *keys: str, length: str = "30 days", slide: str = "1 day", at: str = "at", delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, length, slide).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, key: str, *, gap: str = "30 minutes", at: str = "at", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def resolved_calls(stream: DataFrame, *, expire_s: int = 3600) -> DataFrame:
    """Tool calls joined to their results across batches, in either order (append mode).

    Input: session, kind (call or result), call_id, body. Output: session, call_id,
    call, result, status. A pair leaves as ``resolved`` as soon as both ends are
    there. An end that waits ``expire_s`` seconds leaves alone, a call as
    ``expired``, a result as ``unmatched``, and its state goes, so state holds what
    is open and never grows with the past. The other end may still come: it then
    leaves the same way, and ``latest_calls`` puts both on one row.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(("call", "result"), state.get, strict=True)) if state.exists else {"call": None, "result": None}
        if state.hasTimedOut:
            status = "expired" if held["call"] is not None else "unmatched"
        else:
            for pdf in batches:
                for kind, body in zip(pdf["kind"], pdf["body"], strict=True):
                    if kind in held:
                        held[kind] = body if isinstance(body, str) else ""
            status = "resolved" if None not in held.values() else None
        if status is None:
            state.update((held["call"], held["result"]))
            state.setTimeoutDuration(expire_s * 1000)
            return
        state.remove()
        yield pd.DataFrame([(*key, held["call"], held["result"], status)], columns=["session", "call_id", "call", "result", "status"])

    out = "session string, call_id string, call string, result string, status string"
    return stream.groupBy("session", "call_id").applyInPandasWithState(step, out, "call string, result string", "append", "ProcessingTimeTimeout")


def latest_calls(items: DataFrame) -> DataFrame:
    """One row a call from what ``resolved_calls`` has written: ends that left apart come together as ``late``."""
    one = items.groupBy("session", "call_id").agg(F.max("call").alias("call"), F.max("result").alias("result"), F.max(F.col("status") == "resolved").alias("pair"), F.min("status").alias("status"))
    both = F.col("call").isNotNull() & F.col("result").isNotNull()
    status = F.when(F.col("pair"), "resolved").when(both, "late").otherwise(F.col("status"))
    return one.select("session", "call_id", "call", "result", status.alias("status"))


def run_states(stream: DataFrame, *, stalled_s: int = 1200, abandoned_s: int = 3600) -> DataFrame:
    """(session, state) of runs from rows (session, status) as batches arrive: done ends a run; silence turns it stalled, then abandoned."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (was,) = state.get
            if was == "active":
                state.update(("stalled",))
                state.setTimeoutDuration((abandoned_s - stalled_s) * 1000)
                yield pd.DataFrame([(key[0], "stalled")], columns=["session", "state"])
            else:
                state.remove()
                yield pd.DataFrame([(key[0], "abandoned")], columns=["session", "state"])
            return
        done = any((pdf["status"] == "done").any() for pdf in batches)
        if done:
            state.remove()
        else:
            state.update(("active",))
            state.setTimeoutDuration(stalled_s * 1000)
        yield pd.DataFrame([(key[0], "done" if done else "active")], columns=["session", "state"])

    return stream.groupBy("session").applyInPandasWithState(step, "session string, state string", "state string", "update", "ProcessingTimeTimeout")


def run_states_at(rows: DataFrame, now: Column, *, stalled_s: int = 1200, abandoned_s: int = 3600) -> DataFrame:
    """The same from a table of (session, status, at), at a given time."""
    last = rows.groupBy("session").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))
    idle = F.unix_seconds(now) - F.unix_seconds("at")
    state = F.when(F.col("status").isin("done", "error"), F.col("status")).when(idle >= abandoned_s, "abandoned").when(idle >= stalled_s, "stalled").otherwise("active")
    return last.select("session", state.alias("state"))
