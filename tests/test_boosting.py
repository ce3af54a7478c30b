"""Boosting: objectives against plain loops, the same models over any partitioning, and what a fit may see."""

import numpy as np
import pytest
from dyadlake.operators import boosting as B
from dyadlake.operators import ranking as R
from dyadlake.plans import catalogue as registry
from pyspark.sql import functions as F


def rows(spark, n=600):
    i = F.col("id")
    df = spark.range(n).withColumns({"x": F.pmod(i * 7919, F.lit(101)) / 101.0, "z": F.pmod(i * 104729, F.lit(97)) / 97.0, "g": (i / 30).cast("int")})
    xor = ((F.col("x") > 0.5) != (F.col("z") > 0.5)).cast("int")
    return df.withColumns({"label": xor, "class": F.when(F.col("x") < 0.3, 0).when(F.col("z") < 0.5, 1).otherwise(2), "fold": (F.col("g") % 3).cast("int"), "x": F.when(i % 50 != 7, F.col("x"))})


def test_pair_slopes_are_those_of_all_pairs():
    r = np.random.default_rng(1)
    s, y = r.normal(size=9), np.array([1, 0, 0, 1, 0, 1, 0, 0, 0])
    a, b = np.exp(-s[y > 0]).sum(), np.exp(s[y == 0]).sum()
    loss = lambda v: sum(np.exp(v[j] - v[i]) for i in range(9) for j in range(9) if y[i] and not y[j]) / (3 * 6) * 9 / 2
    g, h, each = B._slopes("pairwise", s[:, None, None], y, np.tile([a, b], (9, 1, 1)), np.tile([3.0, 6.0], (9, 1)))
    assert abs(each.sum() / 2 - loss(s)) < 1e-9
    for i in range(9):
        step = np.eye(9)[i] * 1e-4
        assert abs((loss(s + step) - loss(s - step)) / 2e-4 - g[i, 0, 0]) < 1e-5
        assert abs((loss(s + step) - 2 * loss(s) + loss(s - step)) / 1e-8 - h[i, 0, 0]) < 1e-3
    assert not B._slopes("pairwise", s[:, None, None], y * 0, np.tile([0.0, b], (9, 1, 1)), np.tile([0.0, 9.0], (9, 1)))[0].any()


def test_softmax_slopes():
    s = np.array([[[0.3, -1.0, 2.0]]])
    g, h, loss = B._slopes("softmax", s, np.array([2]), None, None)
    p = np.exp(s) / np.exp(s).sum()
    assert np.allclose(g, p - [0, 0, 1]) and np.allclose(h, p * (1 - p)) and np.allclose(loss, -np.log(p[0, 0, 2]))


def test_learns_and_is_the_same_however_partitioned(spark):
    df = rows(spark)
    a = B.out_of_fold(df, ["x", "z"], 3, "id", rounds=5).cache()
    b = B.out_of_fold(df.repartition(7), ["x", "z"], 3, "id", rounds=5)
    assert a.count() == 600 and R.auc(a, "p", "label", "id").first().auc > 0.97
    assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def test_classes(spark):
    out = B.out_of_fold(rows(spark), ["x", "z"], 3, "id", label="class", objective="softmax", classes=3, rounds=6).collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in out)
    assert np.mean([-np.log(r.p[r["class"]]) for r in out]) < 0.3


def test_pairs_rank_within_groups_where_points_learn_the_groups(spark):
    """Groups have very different shares of positives, which one column tells; what matters within a group is weak."""
    i = F.col("id")
    df = spark.range(1200).withColumns({"g": (i / 20).cast("int"), "x": F.pmod(i * 7919, F.lit(1009)) / 1009.0})
    base = F.pmod(F.col("g") * 37, F.lit(60)) / 60.0
    noise = F.pmod(i * 104729, F.lit(997)) / 997.0
    df = df.withColumns({"base": base, "label": (0.55 * base + 0.15 * F.col("x") + 0.3 * noise > 0.6).cast("int"), "fold": (F.col("g") % 3).cast("int")})
    kw = {"rounds": 4, "depth": 1}
    at = lambda p: R.map_at(p, "g", "p", "label", "id").agg(F.avg("ap")).first()[0]
    points, pairs = B.out_of_fold(df, ["base", "x"], 3, "id", **kw), B.out_of_fold(df, ["base", "x"], 3, "id", objective="pairwise", group="g", **kw)
    assert at(pairs) > at(points) + 0.02
    same = B.out_of_fold(df.repartition(5, "x"), ["base", "x"], 3, "id", objective="pairwise", group="g", **kw)
    assert sorted(pairs.collect(), key=str) == sorted(same.collect(), key=str)


def test_early_stopping_never_sees_the_outer_fold(spark):
    df = rows(spark).withColumn("label", F.when(F.col("id") % 5 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    kw = {"rounds": 8, "rate": 0.9, "patience": 2, "depth": 2}
    model, inner, chosen = B.nested(df, ["x", "z"], 3, "id", **kw)
    assert [len(r) for r in inner] == [2, 2, 2] and chosen == [max(1, round(float(np.median(r)))) for r in inner] and [f.rounds for f in model.fits] == chosen
    changed = df.withColumn("label", F.when(F.col("fold") == 1, 1 - F.col("label")).otherwise(F.col("label")))
    again, inner2, _ = B.nested(changed, ["x", "z"], 3, "id", **kw)
    assert inner[1] == inner2[1] and inner != inner2
    own = lambda m: sorted(B.score(df, m, {1: 1}).where("fold = 1").select("id", "p").collect())
    assert own(model) == own(again)
    assert B.score(df, model, {1: 1}).where("fold <> 1 and p is not null").count() == 0


def test_few_rows_nulls_and_nothing_to_learn(spark):
    one = spark.createDataFrame([(1, None, 0, 0, 1), (2, 1.0, None, 1, 1), (3, float("nan"), 0, 2, None)], "id long, x double, label int, fold int, g int")
    out = B.out_of_fold(one, ["x"], 3, "id", rounds=2)
    assert all(r.p < 0.5 or abs(r.p - 0.5) < 1e-9 for r in out.collect())
    assert B.out_of_fold(one, ["x"], 3, "id", rounds=1, apply_to=one.limit(0)).count() == 0
    assert {r.p for r in B.out_of_fold(one, ["x"], 3, "id", rounds=1, objective="pairwise", group="g").collect()} == {0.0}
    with pytest.raises(ValueError, match="group"):
        B.fit(one, ["x"], [B.Fit(frozenset({0}))], "id", objective="pairwise")


def test_queries(spark, small):
    ranked = registry.QUERIES["pairwise_ranker"](spark, small).cache()
    n = ranked.count()
    assert n > 50 and R.auc(ranked, "score", "label", "doc_id").first().auc > 0.9
    assert ranked.groupBy("source").agg(F.max("place").alias("m"), F.count("*").alias("n")).where("m <> n").count() == 0
    stopped = registry.QUERIES["early_stopped"](spark, small).cache()
    assert stopped.count() == n and R.auc(stopped, "p", "label", "doc_id").first().auc > 0.9
    langs = registry.QUERIES["softmax_languages"](spark, small).collect()
    assert all(abs(r.total - 1) < 1e-6 for r in langs) and np.mean([r.lang == r.predicted for r in langs]) > 0.9
    clone = registry.QUERIES["softmax_clone"](spark, small)
    assert clone.where("abs(p_bet + p_call + p_check + p_fold + p_raise - 1) > 0.00001").count() == 0
    assert clone.agg(F.avg("surprise")).first()[0] < registry.QUERIES["policy_clone"](spark, small).agg(F.avg("surprise")).first()[0]
