"""Average-rank shares in many small groups, against plain loops."""

import math

import pytest
from dyadlake.operators import table_ranks
from dyadlake.plans import catalogue as registry
from pyspark.sql import functions as F


def plain(rows, column):
    """By (g, k): the average rank of a value over the values of its group; none for nulls and what isn't a number."""
    out = {}
    for r in rows:
        v = r[column]
        if v is None or math.isnan(v):
            out[r.g, r.k] = None
            continue
        all_ = [x[column] for x in rows if x.g == r.g and x[column] is not None and not math.isnan(x[column])]
        out[r.g, r.k] = (sum(x < v for x in all_) + (sum(x == v for x in all_) + 1) / 2) / len(all_)
    return out


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_shares_within_equal_plain_loops(spark, batch):
    i = F.col("k")
    df = spark.range(300).withColumnRenamed("id", "k").withColumns({"g": F.floor(F.sqrt(i)) - 9, "small": (i * 7 % 5).cast("int"), "wide": F.when(i % 2 == 0, F.lit(2**62)).otherwise(-(2**62)) + i % 3, "real": F.when(i % 11 == 0, F.lit(float("nan"))).otherwise((i * 13 % 8) / 4 - 1), "gap": F.when(i % 3 > 0, i % 4), "zero": F.when(i % 2 == 0, F.lit(0.0)).otherwise(-F.lit(0.0))})
    rows = df.collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.g, r.k): r for r in table_ranks.shares_within(df, ["small", "wide", "real", "gap", "zero"], ["g"], ["k"], "_pct", ["gap"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 300
    for c in ("small", "wide", "real", "gap", "zero"):
        for at, want in plain(rows, c).items():
            assert got[at][f"{c}_pct"] == (None if want is None else pytest.approx(want, abs=1e-12))
    for r in rows:
        most = max((x.gap for x in rows if x.g == r.g and x.gap is not None), default=0)
        assert got[r.g, r.k].gap_to_max == (None if r.gap is None else r.gap / (most + 1e-6))


def test_rows_without_a_value_may_come_last(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, None), (1, 4, 2), (2, 5, None)], "g long, k long, v long")
    got = {r.k: r.v_pct for r in table_ranks.shares_within(df, ["v"], ["g"], ["k"], last=True).collect()}
    assert got == {4: 1 / 4, 1: 2 / 4, 2: 3.5 / 4, 3: 3.5 / 4, 5: 1.0}


def test_shares_within_of_no_rows(spark):
    assert table_ranks.shares_within(spark.range(0).withColumn("g", F.col("id")), ["id"], ["g"], []).count() == 0


def test_a_task_of_hand_normalised_sorts_each_hand_once_for_its_ranks(spark, small):
    """It held a sort of its own for every column that is ranked."""
    plan = registry.QUERIES["hand_normalised"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    ranks = plan[: plan.index("MapInArrow")] + plan[plan.index("MapInArrow") :].split("Join")[0]
    assert "Window" not in ranks and ranks.count("Sort ") == 1
