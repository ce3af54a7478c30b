"""Pair-hand columns by name: the same values, from the layers that they need."""

from dyadlake.plans import learning as plans
from dyadlake.plans import wide


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_named_columns_are_those_of_the_whole_and_join_fewer_layers(spark, small):
    keys = ["hand_id", "table_id", "p1", "p2"]
    whole = wide.pair_hands(spark, small)
    names = plans._named(plans.HAND, plans.MORE, plans.FAMILIES.values())
    some = wide.pair_hands(spark, small, only=names)
    assert some.columns == [*keys, *names] and some.count() > 0
    of = whole.select(*some.columns)
    assert some.exceptAll(of).count() == 0 and of.exceptAll(some).count() == 0
    assert joins(some) < joins(whole)
    early = wide.pair_hands(spark, small, part="early", only=plans._named(plans.HAND, plans.EARLY))
    assert joins(early) < joins(some)
