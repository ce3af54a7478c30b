"""Playing cards as numbers 0 to 51 (rank * 4 + suit, rank 0 the deuce, 12 the ace): starting-hand scores and exact hand values, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = 15


def rank(card: Column) -> Column:
    return F.floor(card / 4).cast("int")


def suit(card: Column) -> Column:
    return (card % 4).cast("int")


def chen(a: Column, b: Column) -> Column:
    """Points of a starting hand of two cards, never rounded."""
    high, low = F.greatest(rank(a), rank(b)) + 2, F.least(rank(a), rank(b)) + 2
    base = F.when(high == 14, 10.0).when(high == 13, 8.0).when(high == 12, 7.0).when(high == 11, 6.0).otherwise(high / 2.0)
    gap = high - low - 1
    apart = F.when(gap <= 0, 0.0).when(gap == 1, 1.0).when(gap == 2, 2.0).when(gap == 3, 4.0).otherwise(5.0)
    bonus = F.when((gap <= 1) & (high < 12), 1.0).otherwise(0.0)
    unpaired = base + F.when(suit(a) == suit(b), 2.0).otherwise(0.0) - apart + bonus
    return F.when(high == low, F.greatest(F.lit(5.0), 2 * base)).otherwise(unpaired)


def hole_class(a: Column, b: Column) -> Column:
    """One of 169 classes of starting hands."""
    high, low = F.greatest(rank(a), rank(b)) + 2, F.least(rank(a), rank(b)) + 2
    return high * 15 + low + F.when(suit(a) == suit(b), 300).otherwise(0)


def _desc(ranks: Column) -> Column:
    return F.sort_array(ranks, asc=False)


def _straight(ranks: Column) -> Column:
    """The highest rank that ends a straight, null if none does; the wheel ends at the five."""
    holds = lambda h: F.forall(F.sequence(h - 4, h), lambda r: F.array_contains(ranks, F.when(r < 0, 12).otherwise(r)))
    return F.array_max(F.filter(F.sequence(F.lit(3), F.lit(12)), holds))


def _number(ranks: Column, n: int) -> Column:
    """The first n ranks as a number in base 15."""
    return F.aggregate(F.slice(ranks, 1, n), F.lit(0), lambda s, r: s * BASE + r)


def let(value_: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value_), body), F.lit(0))


def value(cards: Column) -> Column:
    """The value of the best five of five to seven distinct cards: category * 15^5 + tie-break, higher is better."""
    every = F.sequence(F.lit(0), F.lit(12))
    counts = lambda ranks: F.transform(every, lambda r: F.size(F.filter(ranks, lambda x: x == r)))
    flush_suit = F.get(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda s: F.size(F.filter(cards, lambda c: suit(c) == s)) >= 5), F.lit(0))
    same = F.transform(F.filter(cards, lambda c: suit(c) == flush_suit), rank)  # empty without a flush
    return let(F.transform(cards, rank), lambda ranks: let(counts(ranks), lambda n: let(same, lambda flush: _value(ranks, n, flush))))


def _value(ranks: Column, n: Column, flush: Column) -> Column:
    """From the ranks, how many cards each of the thirteen has, and the ranks of the flush."""
    every = F.sequence(F.lit(0), F.lit(12))
    of = lambda k: _desc(F.filter(every, lambda r: F.get(n, r) == k))
    singles = _desc(F.array_distinct(ranks))
    but = lambda gone: F.filter(singles, lambda r: ~F.array_contains(gone, r))
    has_flush = F.size(F.coalesce(flush, F.array().cast("array<int>"))) > 0
    straight_flush = F.when(has_flush, _straight(flush))
    four, three, two = of(4), of(3), of(2)
    straight = _straight(ranks)
    first = lambda x: F.get(x, F.lit(0))
    # a full house: the best three with the best other pair or three
    pair_of_full = F.array_max(F.concat(F.slice(three, 2, 1), F.slice(two, 1, 1)))
    unit = BASE**5
    return (
        F.when(straight_flush.isNotNull(), 8 * unit + straight_flush)
        .when(F.array_contains(n, 4), 7 * unit + first(four) * BASE + first(but(F.slice(four, 1, 1))))
        .when(F.array_contains(n, 3) & pair_of_full.isNotNull(), 6 * unit + first(three) * BASE + pair_of_full)
        .when(has_flush, 5 * unit + _number(_desc(flush), 5))
        .when(straight.isNotNull(), 4 * unit + straight)
        .when(F.array_contains(n, 3), 3 * unit + first(three) * BASE**2 + _number(but(F.slice(three, 1, 1)), 2))
        .when(F.size(two) > 1, 2 * unit + _number(two, 2) * BASE + first(but(F.slice(two, 1, 2))))
        .when(F.array_contains(n, 2), unit + first(two) * BASE**3 + _number(but(F.slice(two, 1, 1)), 3))
        .otherwise(_number(singles, 5))
    ).cast("long")


def category(v: Column) -> Column:
    """0 high card, 1 pair, 2 two pairs, 3 three, 4 straight, 5 flush, 6 full house, 7 four, 8 straight flush."""
    return F.floor(v / BASE**5).cast("long")


def few(ranks: Column) -> Column:
    """The value of two to four cards by their ranks 0 to 12: the category of their equal ranks, then the ranks, most frequent first, counted from 2 to 14."""
    keys = F.sort_array(F.array_distinct(F.transform(ranks, lambda x: F.size(F.filter(ranks, lambda y: y == x)) * 100 + x)), asc=False)

    def body(o: Column) -> Column:
        n = lambda i: F.floor(F.get(o, F.lit(i)) / 100)
        kind = F.when(n(0) == 4, 7).when(n(0) == 3, 3).when((n(0) == 2) & (F.coalesce(n(1), F.lit(0)) == 2), 2).when(n(0) == 2, 1).otherwise(0)
        number = F.aggregate(o, F.lit(0), lambda s, x: s * BASE + x % 100 + 2)
        return (kind * BASE**5 + number * F.pow(F.lit(BASE), 5 - F.size(o))).cast("long")

    return let(keys, body)
