"""Average-rank shares of many columns at once, over whole tables or large groups.

One job takes a bounded sample (the rows with the smallest hashes of their key), whose quantiles cut every column into ranges. Each row then sends its values, by column and range, in one exchange; a range's first rank comes from the ranges' counts, a few numbers a group, column and range, and rows are ranked only within
their range. A value with so many rows that the sample shows it twice its share of a range has a range for itself: its rows' rank is known from the counts, so they are neither sent nor sorted, and no value fills a task. The sample only places the cuts: ranks are exact wherever they lie.

``shares_within`` is for many small groups: whole groups lie in one task, which ranks them a batch at a time.

Nulls (and values that are not numbers) have no rank and don't count. Ties share their average rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadlake.sources import files

SAMPLE = 20_000


def cuts(df: DataFrame, columns: Sequence[str], key: Sequence[str], ranges: int) -> list[list[float]]:
    """Where each column's ranges begin, from the sample: its quantiles, and each frequent value by itself."""
    rows = df.select(F.xxhash64(*key).alias("h"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).orderBy("h", *[f"c{i}" for i in range(len(columns))]).limit(SAMPLE).toPandas()
    out = []
    for i in range(len(columns)):
        v = rows[f"c{i}"].to_numpy(float)
        v = np.sort(v[~np.isnan(v)])
        if not len(v):
            out.append([])
            continue
        edges = set(np.quantile(v, np.arange(1, ranges) / ranges, method="lower").tolist()) if ranges > 1 else set()
        values, n = np.unique(v, return_counts=True)
        for x in values[n >= max(2, 2 * len(v) / ranges)].tolist():  # fewer than half as many as ranges
            edges |= {x, math.nextafter(x, math.inf)}
        out.append(sorted(e for e in edges if math.isfinite(e)))
    return out


def average_rank_shares(df: DataFrame, columns: Sequence[str], key: Sequence[str], groups: Sequence[str] = (), suffix: str = "_pct", ranges: int | None = None) -> DataFrame:
    """``df`` with ``<column><suffix>`` for every column: the average rank of its value, ascending, over the number of values in its group. ``key`` identifies rows within a group."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cuts(df, columns, [*groups, *key], ranges)
    numbers = files.stage(df.select(*groups, *key, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"__v{i}") for i, c in enumerate(columns)]))
    dealt = numbers
    some = [i for i, e in enumerate(found) if e]
    if some:
        splits = [[-math.inf, *found[i], math.inf] for i in some]
        dealt = Bucketizer(splitsArray=splits, inputCols=[f"__v{i}" for i in some], outputCols=[f"__r{i}" for i in some], handleInvalid="keep").transform(numbers)
    entry = lambda i: F.struct(F.lit(i).alias("c"), F.col(f"__v{i}").alias("v"), (F.col(f"__r{i}").cast("int") if i in some else F.lit(0)).alias("r"))
    alone = {(i, j + 1) for i in some for j in range(len(found[i]) - 1) if found[i][j + 1] == math.nextafter(found[i][j], math.inf)}  # a value's own range
    long = dealt.select(*groups, *key, F.explode(F.array(*[entry(i) for i in range(len(columns))])).alias("e")).select(*groups, *key, "e.*").where("v is not null")
    own = F.array_contains(F.array(*[F.lit(i * 1_000_000 + j) for i, j in sorted(alone)]), F.col("c") * 1_000_000 + F.col("r")) if alone else F.lit(False)
    long = long.withColumn("own", own)
    counts = long.groupBy(*groups, "c", "r").agg(F.count("*").alias("n"))
    of = Window.partitionBy(*groups, "c")
    counts = counts.select(*groups, "c", "r", F.coalesce(F.sum("n").over(of.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), "n", F.sum("n").over(of).alias("all"))
    counts = files.stage(counts)
    at = Window.partitionBy(*groups, "c", "r")
    sorted_ = long.where(~F.col("own")).select(*groups, *key, "c", "r", (F.rank().over(at.orderBy("v")) - 1).alias("low"), F.count("*").over(Window.partitionBy(*groups, "c", "r", "v")).alias("ties"))
    known = long.where("own").select(*groups, *key, "c", "r", F.lit(0).alias("low"), F.lit(None).cast("long").alias("ties"))
    share = (F.col("before") + F.col("low") + (F.coalesce("ties", "n") + 1) / 2) / F.col("all")
    ranked = sorted_.unionByName(known).join(counts, [*groups, "c", "r"]).select(*groups, *key, "c", share.alias("share"))
    wide = ranked.groupBy(*groups, *key).agg(*[F.max(F.when(F.col("c") == i, F.col("share"))).alias(f"{c}{suffix}") for i, c in enumerate(columns)])
    return df.join(wide, [*groups, *key], "left")


def shares_within(df: DataFrame, columns: Sequence[str], groups: Sequence[str], key: Sequence[str], suffix: str = "_pct", to_max: Sequence[str] = (), last: bool = False) -> DataFrame:
    """``groups``, ``key`` and ``<column><suffix>`` for every column, as ``average_rank_shares`` has it, for many groups of bounded size: one exchange by group, one sort, and ranks of a batch of whole groups at a time, so a task holds a batch and the group that goes on into the next.
    ``to_max``: columns that also give ``<column>_to_max``, the value over the largest of its group and a millionth. ``last``: rows without a value count too, tied after all others."""
    kept = [*groups, *key]
    values = list(dict.fromkeys([*columns, *to_max]))
    double = [T.StructField(c, T.DoubleType()) for c in (*[f"{c}_to_max" for c in to_max], *[f"{c}{suffix}" for c in columns])]
    schema = T.StructType([*[df.schema[c] for c in kept], *double])
    names = schema.names

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*waiting, batch]).combine_chunks()
            starts = _starts(rows, groups)
            done, rest = rows.slice(0, starts[-1]), rows.slice(starts[-1])
            waiting = rest.to_batches()  # the last group may go on
            if done.num_rows:
                yield from _ranked(done, starts[:-1], kept, columns, to_max, names, last).to_batches()
        if waiting:
            rows = pa.Table.from_batches(waiting)
            yield from _ranked(rows, np.zeros(1, int), kept, columns, to_max, names, last).to_batches()

    return df.select(*kept, *values).repartition(*groups).sortWithinPartitions(*groups).mapInArrow(shares, schema)


def _starts(rows: pa.Table, groups: Sequence[str]) -> np.ndarray:
    """Where the groups of sorted rows begin."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for g in groups:
        v = rows.column(g).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _ranked(rows: pa.Table, starts: np.ndarray, kept: Sequence[str], columns: Sequence[str], to_max: Sequence[str], names: Sequence[str], last: bool) -> pa.Table:
    """The average-rank shares of some whole groups, which begin at ``starts``."""
    n = rows.num_rows
    of = np.repeat(np.arange(len(starts)), np.diff([*starts, n]))
    out = [rows.column(c) for c in kept]
    for c in to_max:
        v, none = _numbers(rows, c)
        v = v.astype(float)
        most = np.maximum.reduceat(np.where(none, -np.inf, v), starts)[of]
        out.append(pa.array(v / (most + 1e-6), mask=none))
    for c in columns:
        v, none = _numbers(rows, c)
        order, new = _sorted(v, none, of)
        group = of[order]
        first = np.flatnonzero(new)
        ties = np.diff([*first, n])
        all_ = np.add.reduceat((last | ~none).astype(int), starts)
        rank = first - starts[group[first]] + (ties + 1) / 2
        share = np.empty(n)
        share[order] = np.repeat(rank / np.maximum(all_[group[first]], 1), ties)
        out.append(pa.array(share, mask=None if last else none))
    return pa.table(out, names=list(names))


def _sorted(v: np.ndarray, none: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by group and value, what has no rank last in its group, and which of them begin a value. Whole numbers are sorted as one key with their group, if that fits."""
    new = np.ones(len(v), bool)
    some = none.any()
    if v.dtype.kind == "i" and not some:
        low, span = int(v.min()), int(v.max()) - int(v.min()) + 1
        if span * (int(of[-1]) + 1) < 1 << 62:
            one = of * span + (v.astype(np.int64) - low)
            order = np.argsort(one)
            one = one[order]
            new[1:] = one[1:] != one[:-1]
            return order, new
    order = np.lexsort((v, none, of) if some else (v, of))
    value, last, group = v[order], none[order], of[order]
    new[1:] = (value[1:] != value[:-1]) | (last[1:] != last[:-1]) | (group[1:] != group[:-1])
    return order, new


def _numbers(rows: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A column's values, whole numbers as they are, and where there is none (null, or not a number)."""
    c = rows.column(column).combine_chunks()
    none = c.is_null().to_numpy(zero_copy_only=False)
    v = c.fill_null(0).to_numpy(zero_copy_only=False)
    if v.dtype.kind == "f":
        none = none | np.isnan(v)
        v = np.where(none, 0.0, v)
    return v, none
