"""Folds that hold whole groups and have even shares of every class."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlake.operators import ranking as R

#: Groups that are dealt one by one, the most uneven first.
GREEDY = 20_000


def assign(counts: np.ndarray, folds: int) -> list[int]:
    """Folds for groups (rows of class counts) in the order given: each goes where the classes' shares then differ least between folds; ties to the fold with the fewest rows, then the first."""
    total = np.maximum(counts.sum(0), 1)
    have, out = np.zeros((folds, counts.shape[1])), []
    for c in counts:
        spread = []
        for f in range(folds):
            have[f] += c
            spread.append((round(float(np.std(have / total, axis=0).mean()), 12), float(have[f].sum()), f))
            have[f] -= c
        best = min(spread)[2]
        have[best] += c
        out.append(best)
    return out


def balanced(df: DataFrame, group: str, label: str, folds: int, name: str = "fold") -> DataFrame:
    """(``group``, ``name``): every group's fold. The ``GREEDY`` groups with the most uneven class counts (ties by the group) are assigned one by one; the others, which are smaller, are dealt in turn, in order of their commonest class and size, so no sort by group meets in one task and the driver sees no more than GREEDY rows. A null label is a class, a null group a group."""
    classes = [r[0] for r in df.select(label).distinct().orderBy(label).limit(1000).collect()]  # classes, not rows
    spark = df.sparkSession
    kind = df.schema[group].dataType.simpleString()
    if not classes:
        return spark.createDataFrame([], f"`{group}` {kind}, `{name}` int")
    cells = df.groupBy(group).agg(*[F.count_if(F.col(label).eqNullSafe(F.lit(c))).alias(f"__c{i}") for i, c in enumerate(classes)])
    mean = sum((F.col(f"__c{i}") for i in range(len(classes))), F.lit(0)) / F.lit(len(classes))
    uneven = sum(((F.col(f"__c{i}") - mean) * (F.col(f"__c{i}") - mean) for i in range(len(classes))), F.lit(0.0))
    cells = cells.withColumn("__uneven", F.round(uneven, 6))
    first = cells.orderBy(F.desc("__uneven"), group).limit(GREEDY)
    top = first.collect()
    dealt = assign(np.array([[r[f"__c{i}"] for i in range(len(classes))] for r in top], float).reshape(len(top), len(classes)), folds)
    out = spark.createDataFrame([(r[group], f) for r, f in zip(top, dealt, strict=True)], f"`{group}` {kind}, `{name}` int")
    if len(top) < GREEDY:
        return out
    cut = top[-1]["__uneven"]
    rest = cells.where(F.col("__uneven") <= cut).join(F.broadcast(out.select(F.col(group).alias("__g"))), F.col(group).eqNullSafe(F.col("__g")), "left_anti")
    most = F.array_max(F.array(*[F.struct(F.col(f"__c{i}").alias("n"), F.lit(-i).alias("i")) for i in range(len(classes))]))
    rest = rest.withColumn("__class", most["i"])
    placed = R.ranked(rest, ["__class"], "__uneven", group)
    return out.unionByName(placed.select(group, F.pmod(F.col("place") - 1, F.lit(folds)).cast("int").alias(name)))
