"""Pair features of the pool: exact ranks from one staged copy, and what is sent for them."""

import re

import pytest
from dyadlake.operators import behaviour as B
from dyadlake.operators import pairs as P
from dyadlake.operators import ranking as R
from dyadlake.plans import catalogue as registry
from dyadlake.sources import files
from pyspark.sql import Window
from pyspark.sql import functions as F


def same(a, b):
    return a.columns == b.columns and a.exceptAll(b).count() == 0 == b.exceptAll(a).count()


@pytest.mark.parametrize("ranges", [1, 3, 16, 400])
def test_percent_ranks_wherever_the_cuts_lie(spark, ranges):
    i = F.col("id")
    group = F.when(i % 11 == 0, F.lit(None)).when(i < 1500, 1).when(i == 2999, 3).otherwise(2)  # one group is null, one has one row
    value = F.when(i % 3 == 0, 0).when(i % 7 == 0, (1 << 60) + i % 2).when(i % 5 == 0, 7).otherwise(F.pmod(i * 7919, F.lit(613)) - 300)
    df = files.stage(spark.range(3000).select("id", group.alias("g"), value.cast("long").alias("v"), (i % 4).alias("n")))
    want = df.withColumns({f"{c}_rank": F.percent_rank().over(Window.partitionBy("g").orderBy(c)) for c in ("v", "n")})
    assert same(R.percent_ranks(df, ["g"], "v", "v_rank", {"n": "n_rank"}, ranges), want)


def test_percent_ranks_of_nothing_and_of_one_value(spark):
    empty = files.stage(spark.createDataFrame([], "g int, v long, n long"))
    assert R.percent_ranks(empty, ["g"], "v", "v_rank", {"n": "n_rank"}).collect() == []
    same_ = files.stage(spark.range(9).select(F.lit(1).alias("g"), F.lit(5).cast("long").alias("v"), F.lit(2).cast("long").alias("n")))
    assert {tuple(r) for r in R.percent_ranks(same_, ["g"], "v", "v_rank", {"n": "n_rank"}).select("v_rank", "n_rank").collect()} == {(0.0, 0.0)}


def test_pairs_in_one_pass_are_those_of_the_join(spark):
    i = F.col("id")
    seats = spark.range(400).select(F.when(i < 390, (i / 7).cast("long")).alias("hand"), F.when(i % 13 > 0, F.pmod(i * 31, F.lit(101))).alias("player"), F.when(i % 5 > 0, i).alias("net"))
    join = P.self_join(seats, "hand", "player", ["net"])
    assert join.count() > 500 and same(P.in_one_pass(seats, "hand", "player", ["net"]).select(*join.columns), join)


def test_pool_keeps_pairs_of_hands_without_a_table(spark):
    rows = [(None, 1, 2, -5, 5, 1, 1), (None, 1, 3, 4, -9, 0, 1), (None, 1, 3, -2, 2, None, 1), (7, 1, 2, 3, 4, 1, 0)]
    out = B.pool_features(spark.createDataFrame(rows, "table_id int, p1 long, p2 long, net_1 long, net_2 long, folded_1 int, folded_2 int"))
    got = {(r.table_id, r.p1, r.p2): (r.n, r.moved_12, r.moved_21, r.both_folded, r.moved, r.one_way, r.moved_rank, r.n_rank) for r in out.collect()}
    assert got == {(None, 1, 2): (1, 5, 0, 1.0, 5, 1.0, 0.0, 0.0), (None, 1, 3): (2, 2, 4, 0.0, 6, 2 / 6, 1.0, 1.0), (7, 1, 2): (1, 0, 0, 0.0, 0, None, 0.0, 0.0)}


def test_pool_stages_pairs_once_and_sends_them_once(spark, small, monkeypatch):
    staged = []
    real = files.stage
    monkeypatch.setattr(files, "stage", lambda df, *a, **k: staged.append(real(df, *a, **k)) or staged[-1])
    out = registry.QUERIES["pool_pair_features"](spark, small)
    assert sum(s.columns[:3] == ["table_id", "p1", "p2"] for s in staged) == 1  # three before
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 1 and "rangepartitioning" not in plan
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
