"""Pairs of actors that meet in the same short episodes.

Episodes (hands) have a bounded number of seats, so joining a hand's seats with one another grows with the number of hands. All
joins on the hand share one exchange; results are then dealt out once by pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side(df: DataFrame, keys: Sequence[str], suffix: str, columns: Sequence[str], player: str) -> DataFrame:
    """``df`` as one side of a pair: its player named ``p<suffix>``, its columns suffixed."""
    return df.select(*keys, F.col(player).alias(f"p{suffix}"), *[F.col(c).alias(f"{c}_{suffix}") for c in columns])


def self_join(seats: DataFrame, hand: str, player: str, columns: Sequence[str]) -> DataFrame:
    """Unordered pairs of each hand, p1 < p2."""
    return side(seats, [hand], "1", columns, player).join(side(seats, [hand], "2", columns, player), hand).where("p1 < p2")


def expand(seats: DataFrame, hand: str, player: str) -> DataFrame:
    """The same pairs without a join: a hand's players collected (a bounded number), and its index pairs exploded."""
    players = seats.groupBy(hand).agg(F.array_sort(F.collect_set(player)).alias("ps"))
    rest = lambda x, i: F.transform(F.slice("ps", i + 2, F.size("ps")), lambda y: F.struct(x.alias("p1"), y.alias("p2")))
    return players.select(hand, F.explode(F.flatten(F.transform("ps", rest))).alias("pair")).select(hand, "pair.p1", "pair.p2")


def in_one_pass(seats: DataFrame, hand: str, player: str, columns: Sequence[str]) -> DataFrame:
    """What ``self_join`` returns where a player has one seat in a hand, from a hand's seats collected (a bounded number): seats that lie by hand are read and sorted once, and aren't joined."""
    one = seats.where(F.col(hand).isNotNull() & F.col(player).isNotNull()).groupBy(hand).agg(F.array_sort(F.collect_list(F.struct(player, *columns))).alias("__seats"))
    first = one.select(hand, "__seats", F.posexplode("__seats").alias("__i", "__a"))
    both = first.select(hand, "__a", F.explode(F.slice("__seats", F.col("__i") + 2, F.size("__seats"))).alias("__b"))
    return both.select(hand, *[c for x, k in (("__a", "1"), ("__b", "2")) for c in (F.col(f"{x}.{player}").alias(f"p{k}"), *[F.col(f"{x}.{c}").alias(f"{c}_{k}") for c in columns])])


def members(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both directions of each pair: member, partner, is_first."""
    both = F.array(F.struct(F.col("p1").alias("member"), F.col("p2").alias("partner"), F.lit(1).alias("is_first")), F.struct(F.col("p2").alias("member"), F.col("p1").alias("partner"), F.lit(0).alias("is_first")))
    return pairs.select(*keys, "p1", "p2", F.explode(both).alias("m")).select(*keys, "p1", "p2", "m.*")


def outsiders(pairs: DataFrame, seats: DataFrame, hand: str, player: str) -> DataFrame:
    """The seats of a pair's hand that belong to neither of the two."""
    return pairs.join(seats.withColumnRenamed(player, "outsider"), hand).where("outsider <> p1 and outsider <> p2")


def without_partner(own: DataFrame, with_partner: DataFrame, key: str, total: str, n: str) -> DataFrame:
    """Per member and partner the mean with and without that partner; the latter by subtraction, not by an anti-join.

    ``own``: key, total, n over all rows; ``with_partner``: key, partner, total, n over the shared ones.
    """
    o = own.select(key, F.col(total).alias("own_total"), F.col(n).alias("own_n"))
    rest = F.col("own_n") - F.col(n)
    return with_partner.join(o, key).select(key, "partner", n, (F.col(total) / F.col(n)).alias("mean_with"), ((F.col("own_total") - F.col(total)) / F.nullif(rest, F.lit(0))).alias("mean_without"))
