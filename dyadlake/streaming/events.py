"""Event-time aggregates over the event log as a stream. The functions on frames take batch and streaming frames alike."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlake.sources import files

LATE = "2 hours"


def source(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files at ``path``, a file or a folder, as a stream with their own schema."""
    either = f"{path[:-1]}[{path[-1]}]"  # as a pattern it may be a single file too
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(either)


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str) -> DataFrame:
    return sliding(events, width, width)


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    """Counts and cents by window and type; late events are dropped after ``LATE``."""
    w = F.window("at", width, step)
    n = timed(events).withWatermark("at", LATE).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return n.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """A user's events with less than ``gap`` between them."""
    n = timed(events).withWatermark("at", LATE).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.unix_micros("w.start").alias("start"), "n")


def first_of_each(events: DataFrame) -> DataFrame:
    """Events without repeats of their id."""
    return timed(events).withWatermark("at", LATE).dropDuplicates(["event_id", "at"]).select("event_id", "user_id", "event_type")


def run(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What the stream has produced once all available files are read. State and output lie in the shared folder."""
    out, state = files.new_path(spark), files.new_path(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{0 if mode == 'complete' else number}")

    q = transform(source(spark, path)).writeStream.outputMode(mode).option("checkpointLocation", state).queryName(f"q{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(out)


def arrivals(spark: SparkSession, parts: list[DataFrame], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an appending stream has produced after the parts came in one after the other, each taken up by a new run of the same query.

    A run goes on from the state and the watermark that the last one left in the shared folder, as after a restart.
    """
    folder, out, state = files.new_path(spark), files.new_path(spark), files.new_path(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    for part in parts:
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(part.schema).parquet(folder)
        q = transform(stream).writeStream.outputMode("append").option("checkpointLocation", state).queryName(f"q{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(out)
