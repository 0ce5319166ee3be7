"""Counts over event time, the same for a table and for a stream of its rows.

Operators take any DataFrame with a timestamp ``ts``; on a stream they set a
watermark.  Chains of positions and global quantiles stay batch operators: a
late row can join two chains.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.functions.coords import bin_start
from chromaloom.sources.shared import shared_dir


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """``ts`` as a timestamp with time zone, which watermarks require."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if late and events.isStreaming else out


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    out = timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    return timed(events, late).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    out = timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def binned(fragments: DataFrame, resolution: int) -> DataFrame:
    """Incremental counts of fragments (cell, chrom, start) by bin: update or complete mode on a stream."""
    return fragments.groupBy("cell", "chrom", bin_start("start", resolution).alias("pos")).agg(F.count(F.lit(1)).alias("count"))


def distinct(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key, remembered within the watermark on a stream."""
    out = timed(events, late)
    return out.dropDuplicatesWithinWatermark(keys) if events.isStreaming else out.dropDuplicates(keys)


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at ``path``, a folder or one file (named by a pattern, as a stream's path must not be a file)."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream has to say at present, as a table in the shared folder.

    Runs the stream until its input is used up.  Results that append mode holds
    back behind the watermark are complete only in complete or update mode.
    """
    spark = df.sparkSession
    name = f"drained_{uuid.uuid4().hex}"
    base = f"{shared_dir(spark)}/{name}"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{base}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")

    # complete mode: the last batch holds everything
    q = df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    last = max((p["batchId"] for p in q.recentProgress), default=None)
    return spark.createDataFrame([], df.schema) if last is None else spark.read.schema(df.schema).parquet(f"{base}/out/{last}")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(_events(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz"))


def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding(_events(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz"))


def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(_events(spark, sf_dir)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


def stream_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental count, run as a stream over the events file."""
    events = stream(spark, f"{sf_dir}/events.parquet")
    fragments = events.selectExpr("concat('c', user_id % 8) AS cell", "concat('chr', 1 + user_id % 5) AS chrom", "event_id * 200 + user_id * 13 AS start")
    return drained(binned(fragments, 20_000), "complete")


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user, run as a stream."""
    return drained(distinct(stream(spark, f"{sf_dir}/events.parquet"), ["user_id"]).select("user_id"))
