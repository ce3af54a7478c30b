"""Column builders: each takes columns (or names) and returns a Column, so Catalyst sees plain expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Col, low: float | None = None, high: float | None = None) -> Column:
    """``c`` held between the bounds that are given."""
    out = col(c)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return out if high is None else F.least(out, F.lit(high))


def total(c: Col) -> Column:
    """A sum that is 0, not null, over nothing."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def rate(condition: Column) -> Column:
    """The share of rows for which the condition holds."""
    return F.avg(condition.cast("int"))


def ratio(a: Col, b: Col) -> Column:
    """a / b, null where b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0))


def transfer(net_a: Col, net_b: Col) -> Column:
    """What a lost as far as b won it."""
    return F.least(F.greatest(-col(net_a), F.lit(0)), F.greatest(col(net_b), F.lit(0)))


def picked(first: Column, a: Col, b: Col) -> Column:
    """The column of the one of two sides that ``first`` names."""
    return F.when(first, col(a)).otherwise(col(b))


def before(w: WindowSpec) -> WindowSpec:
    """The rows of the window before the current one."""
    return w.rowsBetween(Window.unboundedPreceding, -1)


def last_before(c: Col, when: Column, w: WindowSpec) -> Column:
    """The value of ``c`` at the last earlier row for which ``when`` holds."""
    return F.last(F.when(when, col(c)), ignorenulls=True).over(before(w))


def running_before(c: Col, w: WindowSpec) -> Column:
    """The sum over earlier rows, 0 at the first."""
    return F.coalesce(F.sum(col(c)).over(before(w)), F.lit(0))


def average_rank_share(keys: Iterable[Col], value: Col) -> Column:
    """Average rank within the keys over their number of rows; null for null."""
    keys = list(keys)
    masked = col(value)
    by_value = Window.partitionBy(*keys).orderBy(masked.asc_nulls_last())
    ties = F.count("*").over(Window.partitionBy(*keys, masked))
    n = F.count("*").over(Window.partitionBy(*keys))
    return F.when(masked.isNotNull(), (F.rank().over(by_value) + (ties - 1) / 2) / n)


def ratio_to_max(c: Col, keys: Iterable[Col], eps: float = 1e-6) -> Column:
    return col(c) / (F.max(col(c)).over(Window.partitionBy(*keys)) + F.lit(eps))


def z_score(c: Col, keys: Iterable[Col], least: float = 1e-6) -> Column:
    """Standardised within the keys; 0 where nothing varies."""
    w = Window.partitionBy(*keys)
    sd = F.coalesce(F.stddev_samp(col(c)).over(w), F.lit(0.0))
    return F.when(sd < least, 0.0).otherwise((col(c) - F.avg(col(c)).over(w)) / sd)


def equal_width_bin(position: Column, bins: int) -> Column:
    """The bin, from 0, of a position between 0 and 1."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(position * bins))).cast("int")


def smoothed(events: Col, trials: Col, prior: Col | float, k: float) -> Column:
    """(events + k * prior) / (trials + k)."""
    p = F.lit(prior) if isinstance(prior, float) else col(prior)
    return (col(events) + k * p) / (col(trials) + k)


def shrunk(with_: Column, without: Column, n: Col, k: float = 25.0) -> Column:
    """The contrast, shrunk to 0 when it rests on few rows."""
    return (with_ - without) * col(n) / (col(n) + k)


def surprise(p: Col) -> Column:
    return -F.log(clip(p, 1e-5, 1.0))


def coincidence(observed: Col, n: Col, p1: Col, p2: Col) -> dict[str, Column]:
    """Joint events beyond what independence expects."""
    expected = col(n) * col(p1) * col(p2)
    return {"expected": expected, "excess": col(observed) - expected, "z": (col(observed) - expected) / F.sqrt(expected + 0.5), "ratio": (col(observed) + 0.5) / (expected + 0.5)}


def tokens_in(c: Col) -> Column:
    """Blank-separated tokens, none of them empty."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), " "), lambda x: x != "")


def mapped(c: Col, table: dict, default: object = None) -> Column:
    """``c`` looked up in a small fixed table."""
    pairs = reduce(lambda a, kv: [*a, F.lit(kv[0]), F.lit(kv[1])], table.items(), [])
    found = F.try_element_at(F.create_map(*pairs), col(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def fold_of(key: Col, folds: int, seed: int = 0) -> Column:
    """A fold by arithmetic on an integer key: the same on every engine and for every partitioning."""
    return F.pmod(col(key) * 7919 + seed, F.lit(10007)) % folds


def rounded(c: Col, places: int = 6) -> Column:
    """For results that other engines must reproduce: -0.0 is 0.0."""
    return F.round(col(c).cast("double"), places) + F.lit(0.0)
