"""Two-path decisions under a budget: a model for the most promising rows, a heuristic for all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlake.operators import ranking as R
from dyadlake.operators import table_ranks


def route(df: DataFrame, weights: dict[str, float], budget: int, key: str) -> DataFrame:
    """``df`` with ``mixture`` (the weighted mean of its columns' average-rank shares over the table), ``place`` (1: the largest, ties by the smallest key) and ``routed``: the first ``budget`` places, exactly that many, or all rows where there are fewer.

    A null value's share is 0. Mixtures are rounded to twelve places, so that sums of equal shares tie."""
    names = list(weights)
    shares = table_ranks.average_rank_shares(df.select(key, *names), names, [key], suffix="__pct").select(key, *[f"{c}__pct" for c in names])
    mixed = sum((F.lit(w) * F.coalesce(F.col(f"{c}__pct"), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0)) / F.lit(sum(weights.values()))
    rows = df.join(shares, key).withColumn("mixture", F.round(mixed, 12)).drop(*[f"{c}__pct" for c in names])
    return R.ranked(rows, [], "mixture", key).withColumn("routed", F.col("place") <= budget)


def evidence(routed: DataFrame, rows: DataFrame, pair: str, key: str, model: str, heuristic: str, k: int = 5) -> DataFrame:
    """(pair, routed, rank, key): the k best rows of every pair by the model's score where the pair is routed and the model has scored it, else by the heuristic's; ties by the smallest key. A pair with fewer rows gives fewer."""
    both = rows.join(routed.select(pair, "routed"), pair)
    use = F.col("routed") & F.col(model).isNotNull()
    score = F.struct(use.cast("int").alias("by_model"), F.when(use, F.col(model)).otherwise(F.col(heuristic)).alias("score"), (-F.col(key)).alias("tie"), F.col(key).alias("key"))
    place = F.row_number().over(R.Window.partitionBy(pair).orderBy(F.desc("s")))
    return both.select(pair, "routed", score.alias("s")).withColumn("rank", place).where(F.col("rank") <= k).select(pair, "routed", "rank", F.col("s.key").alias(key))
