"""Grouped operators: best rows, ordered strings, out-of-fold encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group with their ``place`` from 1; Spark keeps k rows of each group on both sides of the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def z_scores(df: DataFrame, keys: Sequence[str], value: str, name: str, least: float = 1e-6) -> DataFrame:
    """``df`` with ``name``: ``value`` standardised within its keys, 0 where nothing varies; by an aggregate and a join, so no key is sorted into one task."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("__sd"))
    z = F.when(F.col("__sd") < least, 0.0).otherwise((F.col(value) - F.col("__mean")) / F.nullif(F.col("__sd"), F.lit(0.0)))
    return df.join(stats, list(keys)).withColumn(name, z).drop("__mean", "__sd")


def ordered_tokens(token: Column, order: Sequence[str]) -> Column:
    """An aggregate: the group's tokens as an array in order. Meant for groups of bounded size, an episode or a street."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, token.alias("t")))), lambda x: x["t"])


def out_of_fold_rate(df: DataFrame, keys: Sequence[str], fold: str, label: str, m: float) -> DataFrame:
    """``df`` with ``encoded``: the key's smoothed mean label over the other folds, by subtraction of the own fold's sums."""
    by_fold = df.groupBy(*keys, fold).agg(F.sum(label).alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    rest = by_fold.withColumns({"s": F.sum("s").over(w) - F.col("s"), "n": F.sum("n").over(w) - F.col("n")})
    totals = df.groupBy(fold).agg(F.sum(label).alias("fs"), F.count("*").alias("fn"))
    everything = totals.agg(F.sum("fs").alias("ts"), F.sum("fn").alias("tn"))
    priors = totals.join(F.broadcast(everything)).select(fold, ((F.col("ts") - F.col("fs")) / F.nullif(F.col("tn") - F.col("fn"), F.lit(0))).alias("prior"))
    out = df.join(rest, [*keys, fold]).join(F.broadcast(priors), fold)
    return out.withColumn("encoded", (F.col("s") + m * F.col("prior")) / (F.col("n") + m)).drop("s", "n", "prior")
