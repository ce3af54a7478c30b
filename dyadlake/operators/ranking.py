"""Ranking over whole tables and hot groups without a single-task window, and metrics on top of it.

Rows are dealt by ranges of (groups, score, tie), as many as ``spark.sql.shuffle.partitions`` says, and staged;
rows that tie on the score are cut apart by the tie. A few numbers for each group and range give every range its offset.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadlake.sources import files


def _ranged(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` staged in ranges, with __p (the range) and __m (the row's number, rising within a range)."""
    keys = [*map(F.col, groups), *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id())
    return files.stage(rows.withColumn("__p", F.shiftright("__m", 33)))


def ranked(df: DataFrame, groups: Sequence[str], score: str, tie: str, sums: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``place`` (1 is the highest score, ties by the smallest ``tie``) and running sums ``cum_<c>``, within each group."""
    rows = _ranged(df, groups, [F.desc(score), F.col(tie)])
    parts = rows.groupBy(*groups, "__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"), *[F.sum(c).alias(f"__{c}") for c in sums])
    earlier = Window.partitionBy(*groups).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*groups, "__p", "__first", *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__o_{c}") for c in ("n", *sums)])
    w = Window.partitionBy(*groups, "__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)
    for c in sums:
        rows = rows.withColumn(f"cum_{c}", F.sum(c).over(w))
    out = rows.join(before, [*groups, "__p"])
    out = out.withColumns({"place": (F.col("__m") - F.col("__first") + 1 + F.col("__o_n")).cast("long"), **{f"cum_{c}": F.col(f"cum_{c}") + F.col(f"__o_{c}") for c in sums}})
    return out.drop("__p", "__m", "__first", "__o_n", *[f"__o_{c}" for c in sums])


def tied(df: DataFrame, groups: Sequence[str], value: str, tie: str) -> DataFrame:
    """``df`` with, in its group, ``__low``: rows of smaller values; ``__ties``: rows of its value; ``__before``: rows of smaller values, or of its own and an earlier tie; ``__all``: rows. Null values come first.

    A value with many rows may fill several ranges: what it has in each comes from the ranges' first and last values, so no value meets in one task.
    """
    rows = _ranged(df, groups, [F.col(value).asc_nulls_first(), F.col(tie)])
    within = Window.partitionBy(*groups, "__p")
    rows = rows.withColumns({"__in": F.rank().over(within.orderBy(F.col(value).asc_nulls_first())) - 1, "__own": F.count("*").over(Window.partitionBy(*groups, "__p", value))})
    edge = F.struct(F.col(value).alias("v"), F.col("__own").alias("c"))
    parts = rows.groupBy(*groups, "__p").agg(F.count("*").alias("n"), F.min("__m").alias("first"), F.min_by(edge, "__m").alias("a"), F.max_by(edge, "__m").alias("z"))
    by = Window.partitionBy(*groups).orderBy("__p")
    one = F.col("a.v").eqNullSafe(F.col("z.v"))
    parts = parts.withColumns({"o": F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "go": F.coalesce(F.lag("z").over(by)["v"].eqNullSafe(F.col("a.v")) & F.lag("n").over(by).isNotNull(), F.lit(False)), "all": F.sum("n").over(Window.partitionBy(*groups))})
    # where the last value of a range begins: here, or where it began in an earlier range
    begins = F.when(~one, F.col("o") + F.col("n") - F.col("z.c")).when(~F.col("go"), F.col("o"))
    parts = parts.withColumn("z0", F.last(begins, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.withColumn("a0", F.when(F.col("go"), F.lag("z0").over(by)).otherwise(F.col("o")))
    # all rows of a value that lies on an edge
    edges = parts.select(*groups, F.explode(F.array_distinct(F.array(F.struct("a0", F.col("__p").alias("p"), F.col("a.c").alias("c")), F.struct(F.col("z0").alias("a0"), F.col("__p").alias("p"), F.col("z.c").alias("c"))))).alias("e"))
    whole = edges.groupBy(*groups, F.col("e.a0").alias("__at")).agg(F.sum("e.c").alias("__whole"))
    found = parts.select(*groups, "__p", F.col("o").alias("__o"), F.col("first").alias("__first"), F.col("all").alias("__all"), F.col("a.v").alias("__v"), F.col("a0").alias("__a0"), F.col("z0").alias("__z0"))
    for k in ("a", "z"):
        found = found.join(whole.withColumnsRenamed({"__at": f"__{k}0", "__whole": f"__{k}n"}), [*groups, f"__{k}0"])
    out = rows.join(found, [*groups, "__p"])
    low = F.when(F.col(value).eqNullSafe(F.col("__v")), F.col("__a0")).otherwise(F.col("__o") + F.col("__in"))
    out = out.withColumn("__low", low)
    ties = F.when(F.col("__low") == F.col("__a0"), F.col("__an")).when(F.col("__low") == F.col("__z0"), F.col("__zn")).otherwise(F.col("__own"))
    out = out.withColumns({"__ties": ties, "__before": F.col("__o") + F.col("__m") - F.col("__first")})
    return out.drop("__p", "__m", "__first", "__in", "__own", "__o", "__v", "__a0", "__z0", "__an", "__zn")


def positions(df: DataFrame, groups: Sequence[str], time: str, tie: str, name: str) -> DataFrame:
    """``df`` with ``name``: its position from 0 in its group by a timestamp without time zone, then ``tie``."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{time}`)")
    return ranked(df.withColumn("__t", -micros), groups, "__t", tie).withColumn(name, F.col("place") - 1).drop("place", "__t")


TIED = ("__low", "__ties", "__before", "__all")


def percent_rank(df: DataFrame, groups: Sequence[str], value: str, name: str, tie: str) -> DataFrame:
    """``df`` with ``name``: (rank - 1) / (rows - 1) in its group; 0 in a group of one. ``tie`` only deals equal values out."""
    share = F.coalesce(F.col("__low") / F.nullif(F.col("__all") - 1, F.lit(0)), F.lit(0.0))
    return tied(df, groups, value, tie).withColumn(name, share).drop(*TIED)


def _looked_up(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the other columns of a staged table of these keys, which may be null. A table of up to 200,000 rows goes to every task, so that no key's rows meet in one."""
    other = table.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return df.join(F.broadcast(other) if table.count() <= 200_000 else other, same).drop(*[f"__k_{k}" for k in keys])


def _share_below(low: Column, n: Column) -> Column:
    return F.coalesce(low / F.nullif(n - 1, F.lit(0)), F.lit(0.0))


def percent_ranks(df: DataFrame, groups: Sequence[str], value: str, name: str, few: dict[str, str], ranges: int | None = None) -> DataFrame:
    """``df``, a stage, with ``name``: the percent rank of a whole number (no nulls) in its group, and those of further columns, ``few``, which have few values in a group. Nothing is staged but counts, and a row is sent once at most.

    Quantiles cut the value's range, so that no part has many rows but one of a single value, and every part's counts give its first rank. Rows are sent to their group and part and ranked there; in parts of a single value the first rank is all rows', so they stay where they are.
    The quantiles are approximate and only place the cuts: ranks are exact wherever they lie. What ``few`` has is ranked by its values' counts.
    """
    ranges = max(2, ranges or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = df.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], max(10_000, 10 * ranges)).alias("q")).first().q or []  # one row
    common = {v for v, w in zip(found, found[1:], strict=False) if v == w and abs(v) < 1 << 53}
    edges = sorted({float(e) for v in found for e in ((v, v + 1) if v in common else (v,))})
    alone = [k + 1 for k, e in enumerate(edges) if e in common]
    cut = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="__v", outputCol="__r").transform(df.withColumn("__v", F.col(value).cast("double"))) if edges else df.withColumns({"__v": F.lit(0.0), "__r": F.lit(0.0)})
    rows = cut.drop("__v").withColumn("__r", F.col("__r").cast("int"))
    every, earlier = Window.partitionBy(*groups), lambda c: Window.partitionBy(*groups).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)

    def firsts(of: DataFrame, c: str) -> DataFrame:
        counts = of.groupBy(*groups, c).agg(F.count("*").alias("__n"))
        return files.stage(counts.select(*groups, c, F.coalesce(F.sum("__n").over(earlier(c)), F.lit(0)).alias("__low"), F.sum("__n").over(every).alias("__all")))

    within = F.rank().over(Window.partitionBy(*groups, "__r").orderBy(value)) - 1
    single = F.col("__r").isin(alone)
    out = rows.where(~single).withColumn("__in", within).unionByName(rows.where(single).withColumn("__in", F.lit(0)))
    out = _looked_up(out, firsts(rows, "__r"), [*groups, "__r"]).withColumn(name, _share_below(F.col("__low") + F.col("__in"), F.col("__all"))).drop("__r", "__in", "__low", "__all")
    for c, rank in few.items():
        out = _looked_up(out, firsts(df, c), [*groups, c]).withColumn(rank, _share_below(F.col("__low"), F.col("__all"))).drop("__low", "__all")
    return out


def average_rank_share(df: DataFrame, groups: Sequence[str], value: str, name: str, tie: str) -> DataFrame:
    """``df`` with ``name``: average rank over the rows of its group, for groups of any size, without nulls."""
    share = (F.col("__low") + (F.col("__ties") + 1) / 2) / F.col("__all")
    return tied(df, groups, value, tie).withColumn(name, share).drop(*TIED)


def _counted(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Distinct values of each group with their rows (__ties), rows up to them (cum___ties) and all rows (__all)."""
    n = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("__ties"))
    r = ranked(n.withColumn("__neg", -F.col(value)), groups, "__neg", value, ["__ties"])
    total = n.groupBy(*groups).agg(F.sum("__ties").alias("__all"))
    return r.join(total, list(groups)) if groups else r.join(F.broadcast(total))


def quantiles(df: DataFrame, groups: Sequence[str], value: str, disc: dict[str, float] | None = None, cont: dict[str, float] | None = None) -> DataFrame:
    """Exact quantiles by name: ``disc`` are values that occur, ``cont`` are interpolated. No group's values meet in one task or one buffer."""
    r = _counted(df, groups, value)
    at = lambda place: F.min(F.when(F.col("cum___ties") >= place, F.col(value)))
    n = F.col("__all")
    found = {k: at(F.ceil(n * p - 1e-9)) for k, p in (disc or {}).items()}
    spread = {}
    for k, p in (cont or {}).items():
        low = F.floor((n - 1) * p)
        spread[k] = (at(low + 1), at(F.ceil((n - 1) * p) + 1), F.max((n - 1) * p - low))
    out = r.groupBy(*groups).agg(*[c.alias(k) for k, c in found.items()], *[c.alias(f"__{k}_{i}") for k, cs in spread.items() for i, c in enumerate(cs)])
    mixed = {k: (F.col(f"__{k}_0") + (F.col(f"__{k}_1") - F.col(f"__{k}_0")) * F.col(f"__{k}_2")).cast("double") for k in spread}
    return out.select(*groups, *found, *[c.alias(k) for k, c in mixed.items()])


def average_precision(df: DataFrame, groups: Sequence[str], score: str, label: str, tie: str) -> DataFrame:
    """ap per group: the mean over positives of the precision at their place; null without a positive."""
    r = ranked(df, groups, score, tie, [label])
    hits = F.sum(F.col(label) * F.col(f"cum_{label}") / F.col("place"))
    return r.groupBy(*groups).agg((hits / F.nullif(F.sum(label), F.lit(0))).alias("ap"))


def weighted_average_precision(df: DataFrame, groups: Sequence[str], score: str, label: str, weight: str, tie: str) -> DataFrame:
    """The same with rows that stand for ``weight`` rows each."""
    mass = df.withColumn("__mass", F.col(label) * F.col(weight))
    r = ranked(mass, groups, score, tie, [weight, "__mass"])
    hits = F.sum(F.col("__mass") * F.col("cum___mass") / F.col(f"cum_{weight}"))
    return r.groupBy(*groups).agg((hits / F.nullif(F.sum("__mass"), F.lit(0))).alias("ap"))


def map_at(df: DataFrame, group: str, score: str, label: str, tie: str, k: int = 5) -> DataFrame:
    """Per group with a positive: average precision over its first k rows, out of at most k positives."""
    n = df.groupBy(group).agg(F.sum(label).alias("relevant")).where("relevant > 0")
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    top = df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    seen = F.sum(label).over(Window.partitionBy(group).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    gains = top.withColumn("gain", F.col(label) * seen / F.col("place")).groupBy(group).agg(F.sum("gain").alias("gain"))
    return n.join(gains, group).select(group, (F.col("gain") / F.least("relevant", F.lit(k))).alias("ap"))


def average_ranks(df: DataFrame, value: str, name: str, tie: str) -> DataFrame:
    """``df`` with ``name``: the ascending average rank of ``value`` over the whole table."""
    return tied(df, [], value, tie).withColumn(name, F.col("__low") + (F.col("__ties") + 1) / 2).drop(*TIED)


def auc(df: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """One row: the area under the ROC curve by the rank sum."""
    r = average_ranks(df, score, "__r", tie)
    p, n = F.sum(label), F.count("*") - F.sum(label)
    return r.agg(((F.sum(F.col("__r") * F.col(label)) - p * (p + 1) / 2) / F.nullif(p * n, F.lit(0))).alias("auc"))
