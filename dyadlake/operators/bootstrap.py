"""Bootstrap intervals over groups: what each group adds is worked out once, then resampled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cumulative shares, of 10,007, of Poisson draws of mean 1: below the k-th, a row counts k times.
POISSON = (3681, 7363, 9204, 9817, 9970, 10001)
SCALE = 1_000_000_000


def weights(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """How often each key counts in each draw: arithmetic on both, so draws are the same in every partitioning and engine."""
    return np.searchsorted(POISSON, (keys[:, None] * 7919 + draws[None, :] * 104729) % 10007, side="right")


def sums(df: DataFrame, key: str, value: str, draws: int) -> DataFrame:
    """(draw, total, n): of each resample, the weighted sum of ``value`` (in units of 1e-9, rounded) and of the weights. A task adds its own rows into one array a column, whatever their number; so many rows go on as there are draws and tasks. ``key``: a whole number; nulls of either column are left out."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros((2, draws), np.int64)
        for b in batches:
            k, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i in range(0, draws, 250):
                w = weights(k.astype(np.int64), np.arange(i, min(i + 250, draws)))
                have[0, i : i + 250] += v.astype(np.int64) @ w
                have[1, i : i + 250] += w.sum(0)
        at = np.flatnonzero(have[1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(have[0, at]), pa.array(have[1, at])], names=["draw", "total", "n"])

    whole = df.select(F.col(key).cast("long").alias("key"), F.round(F.col(value) * SCALE).cast("long").alias("value")).where("key is not null and value is not null")
    return whole.mapInArrow(add, "draw int, total bigint, n bigint").groupBy("draw").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def interval(df: DataFrame, key: str, value: str, draws: int = 2000, level: float = 0.95) -> DataFrame:
    """One row: the number of draws with any row, the low, middle and high mean over them (values that occur), and the share of draws with a positive mean."""
    mean = sums(df, key, value, draws).withColumn("mean", F.col("total") / F.col("n") / SCALE)
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY mean)")  # noqa: E731  (one row a draw)
    edge = (1 - level) / 2
    return mean.agg(F.count("*").alias("draws"), at(round(edge, 6)).alias("low"), at(0.5).alias("middle"), at(round(1 - edge, 6)).alias("high"), F.avg((F.col("total") > 0).cast("int")).alias("better"))
