"""Target encodings for two levels of folds, from one cube of sums.

A model for outer fold k is fitted to the rows of the other outer folds and scored on those of k. What a row's key is encoded as in it must not contain labels of fold k, nor, for a row that is fitted to, its own label: rows of k take the mean over all other outer folds; rows of another outer fold take the mean over the outer folds but k and
the inner folds but their own. All of these are sums of the cube (key, outer fold, inner fold), so one aggregation gives the encodings of every row for every k. Means are smoothed by ``m`` rows of the mean over the same folds.

What a row is encoded as follows from its key and its two folds alone. So the rows are read once for the cube's cells, encodings are worked out for the cells that occur, and rows look theirs up: by a broadcast up to ``SMALL`` cells, beyond it by a shuffle, in which rows of a frequent key are dealt to ``DEALT`` copies
of its cells.

A null key is a key. Where the rows of the other folds have no label to show, the encoding is null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadlake.sources import files

SMALL = 200_000
DEALT = 64


def _totals(labels: Sequence[str], outer: str, inner: str, folds: int, inners: int, name: str) -> list[Column]:
    """Array aggregates over cells: the number of rows (``<name>_n``) and the sum of each label (``<name>_<label>``) by outer and inner fold, outer first."""
    here = [(F.col(outer) == o) & (F.col(inner) == i) for o in range(folds) for i in range(inners)]
    total = lambda v: F.array(*[F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0)) for c in here])
    return [total("__n").alias(f"{name}_n"), *[total(f"__y_{y}").alias(f"{name}_{y}") for y in labels]]


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    """Equal in all columns; nulls are equal."""
    return reduce(lambda x, y: x & y, [F.col(p).eqNullSafe(F.col(q)) for p, q in zip(a, b, strict=True)])


def two_level(df: DataFrame, keys: Sequence[str], labels: Sequence[str], outer: str, inner: str, folds: int, inners: int, m: float, salt: str, prefix: str = "enc_") -> DataFrame:
    """``df`` with ``enc_<label>``: an array whose k-th element encodes the row's keys for the model of outer fold k. ``labels``: whole-number columns without nulls. ``salt``: a column to deal rows of a frequent key by."""
    at = [*keys, outer, inner]
    cells = files.stage(df.groupBy(*at).agg(F.count("*").alias("__n"), *[F.sum(y).alias(f"__y_{y}") for y in labels]))
    sums = cells.groupBy(*keys).agg(*_totals(labels, outer, inner, folds, inners, "__s")).withColumnsRenamed({k: f"__k_{i}" for i, k in enumerate(keys)})
    whole = cells.agg(*_totals(labels, outer, inner, folds, inners, "__t"))

    def over(totals: str, k: int) -> Column:
        """The sum of the cells that a row may see for outer fold k."""
        seen = [F.when((F.col(outer) == k) | (F.col(inner) != i), F.get(totals, F.lit(o * inners + i))).otherwise(0) for o in range(folds) if o != k for i in range(inners)]
        total = seen[0]
        for c in seen[1:]:
            total = total + c
        return total

    def encoded(y: str, k: int) -> Column:
        prior = over(f"__t_{y}", k) / F.nullif(over("__t_n", k).cast("double"), F.lit(0.0))
        return (over(f"__s_{y}", k) + m * prior) / (over("__s_n", k) + m)

    found = cells.join(sums, _same(keys, [f"__k_{i}" for i in range(len(keys))])).join(F.broadcast(whole))  # one row
    found = found.select(*at, *[F.array(*[encoded(y, k) for k in range(folds)]).alias(f"{prefix}{y}") for y in labels])
    rows, extra = df, []
    if cells.count() <= SMALL:
        found = F.broadcast(files.stage(found))
    else:
        found = found.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
        rows, extra = df.withColumn("__deal", F.pmod(F.xxhash64(salt), F.lit(DEALT)).cast("int")), ["__deal"]
    named = [f"__c_{i}" for i in range(len(at) + len(extra))]
    found = found.withColumnsRenamed(dict(zip([*at, *extra], named, strict=True)))
    return rows.join(found, _same([*at, *extra], named)).select(*df.columns, *[f"{prefix}{y}" for y in labels])
