"""Deliveries as a stream: folded into current state batch by batch, and counted in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacantia.operators.upkeep import fold_observations


def read_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observation files as they arrive in a folder; their columns are fixed, so no file is read to infer them."""
    return spark.readStream.schema("opportunity_id string, source string, source_url string, observed_at timestamp").parquet(folder)


def fold_into(stream: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Keep under `state` the last sight of each (id, source, url), one version a batch.

    A batch is folded with the version before it and written beside it; a batch that is run again after a failure
    writes the same version again. Late and repeated rows change nothing, as sights only grow.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(F.col("opportunity_id").alias("id"), F.lower(F.trim("source")).alias("source"), F.col("source_url").alias("url"), F.col("observed_at").alias("at"))
        before = current(spark, state, number)
        both = new if before is None else new.unionByName(before)
        fold_observations(both).write.mode("overwrite").parquet(f"{state}/version={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, state: str, before: int | None = None) -> DataFrame | None:
    """The newest version under `state` (older than `before`, if given); None if there is none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(state)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    numbers = [int(f.getPath().getName().partition("=")[2]) for f in fs.listStatus(at) if f.getPath().getName().startswith("version=")]
    numbers = [n for n in numbers if before is None or n < before]
    return spark.read.parquet(f"{state}/version={max(numbers)}") if numbers else None


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, source, sights): rows by window of event time; rows later than `late` behind the newest are dropped.

    Works on streams and on tables alike.
    """
    rows = stream.withWatermark("observed_at", late) if stream.isStreaming else stream
    n = rows.groupBy(F.window("observed_at", width), F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("sights"))
    return n.select(F.col("window.start").alias("start"), "source", "sights")
