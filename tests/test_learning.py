"""Models: held-out quality and protocol, on synthetic rows."""

import os

import pytest
from dyadlake.operators import learning as L
from dyadlake.operators import ranking as R
from dyadlake.operators import wide
from dyadlake.plans import catalogue as registry
from dyadlake.plans import interactions as plays
from dyadlake.plans import learning as plans
from dyadlake.plans import wide as hands_of
from pyspark.sql import functions as F

from conftest import TESTDATA

MIDDLE = f"{TESTDATA}/sf0.01"


def rows(spark, n=600):
    i = F.col("id")
    df = spark.range(n).withColumns({"x": F.pmod(i * 7919, F.lit(101)) / 101.0, "z": F.pmod(i * 104729, F.lit(97)) / 97.0})
    truth = (F.col("x") > 0.6).cast("int")
    return df.withColumns({"truth": truth, "fold": (i % 3).cast("int"), "known": F.when(i % 2 == 0, truth)})


def test_out_of_fold_scores_every_row_once_and_well(spark):
    df = rows(spark).withColumn("label", F.col("truth").cast("double"))
    out = L.out_of_fold(df, lambda: L.logistic(["x", "z"]), "fold", 3)
    assert out.count() == 600 and out.select("id").distinct().count() == 600
    assert R.auc(out, "p", "truth", "id").first().auc > 0.98


def test_boosted_learns(spark):
    df = rows(spark).withColumn("label", F.col("truth").cast("double"))
    out = L.probability(L.boosted(["x", "z"]).fit(df.where("fold < 2")), df.where("fold = 2"))
    assert R.auc(out, "p", "truth", "id").first().auc > 0.98


def test_pu_rounds_rank_hidden_positives(spark):
    out = L.pu_rounds(rows(spark), ["x", "z"])
    assert R.auc(out.where("known is null"), "p", "truth", "id").first().auc > 0.95


def test_mil_rounds_find_the_rows_that_make_a_bag_positive(spark):
    i = F.col("id")
    df = spark.range(400).withColumns({"bag": (i / 20).cast("int"), "hot": (i % 20 < 3).cast("int")})
    df = df.withColumn("bag_label", (F.col("bag") % 2).cast("int")).withColumn("x", F.when((F.col("hot") == 1) & (F.col("bag_label") == 1), 1.0).otherwise(0.0) + F.pmod(i * 31, F.lit(10)) / 50.0).withColumn("z", F.lit(1.0) * (i % 7))
    out = L.mil_rounds(df, "bag", ["x", "z"], "id", top=3)
    best = out.where("bag_label = 1").withColumn("k", F.row_number().over(L.Window.partitionBy("bag").orderBy(F.desc("p"), "id"))).where("k <= 3")
    assert best.agg(F.avg("hot")).first()[0] == 1.0


def test_bag_and_rank_share(spark):
    df = rows(spark).withColumn("label", F.col("truth").cast("double"))
    out = L.rank_share(L.bagged(df, ["x", "z"], (1, 2), "fold", 3), "p", "id")
    assert out.agg(F.max("share"), F.count("*")).first() == (1.0, 600)
    assert R.auc(out, "p", "truth", "id").first().auc > 0.98


MODELS = sorted(n for n, f in registry.QUERIES.items() if f.__module__ == "dyadlake.plans.learning")


@pytest.mark.parametrize("name", MODELS)
def test_model_queries_score_every_row_once(spark, small, name):
    out = registry.QUERIES[name](spark, small).cache()
    keys = [c for c in ("p1", "p2", "bag", "hand_id", "event_id", "feature", "labels", "scorer") if c in out.columns]
    assert 0 < out.count() == out.select(keys).distinct().count()
    for f in out.schema:
        if f.dataType.simpleString() == "double" and f.name != "spread":
            assert out.where(F.col(f.name).isNull() | F.isnan(f.name)).count() == 0
    out.unpersist()


def test_tables_are_left_out_whole(spark, small):
    out = registry.QUERIES["leave_table_out"](spark, small)
    assert out.groupBy("table_id").agg(F.count_distinct("fold").alias("n")).where("n <> 1").count() == 0
    hands = registry.QUERIES["hand_ranker_oof"](spark, small)
    assert hands.where(F.col("fold") != F.col("table_id") % plans.FOLDS).count() == 0


def test_hand_ranker_takes_two_seeds_of_both_models_and_evidence_as_the_label_of_both(spark, small, monkeypatch):
    fits = []
    hands = plans._known_hands(spark, small).select("p1", "p2", "hand_id", "known", "evidence").cache()
    monkeypatch.setattr(L, "boosted", lambda features, weight=None, seed=7, subset="all": (weight, seed))

    def scored(df, make, fold, folds, apply_to=None, before=None):
        fits.append((make(), {tuple(r) for r in df.groupBy("known", "evidence", "label", "w").count().collect()}))
        return (df if apply_to is None else apply_to).withColumn("p", F.lit(make()[1] / 100) + F.col("w") / 1000)

    monkeypatch.setattr(L, "out_of_fold", scored)
    out = registry.QUERIES["hand_ranker_oof"](spark, small)
    n = {(r.known, r.evidence): r["count"] for r in hands.groupBy("known", "evidence").count().collect()}
    assert len(n) == 4  # positive and negative pairs have hands of both kinds
    own = {(1, e, float(e), 1.0, n[1, e]) for e in (0, 1)}
    every = {(k, e, float(k * e), 8.0 if k * e else 1.0, n[k, e]) for k, e in n}
    assert fits == [(("w", 7), own), (("w", 18), own), (("w", 7), every), (("w", 18), every)]
    assert out.count() == hands.count() and out.where("p = 0.126 and suspicion = IF(known * evidence = 1, 0.133, 0.126)").count() == hands.count()


def test_no_feature_is_a_label_or_made_of_one(spark, small):
    assert not set(plans.FAMILIES.values()) & {*plans.HAND, *plans.MORE}
    made = {c for f in ("interaction", "outsiders", "anatomy", "notebook", "residuals", "heuristics", "strength", "made") for c in wide.FAMILIES[f]} - {"opposite_net"}
    assert not made & {*plans.HAND, *plans.MORE} - {"opposite_net"}
    hands = plans.labelled_hands(spark, small)
    for c in (*plans.HAND, *plans.MORE):  # no cut of a single feature gives the label
        low, high = (hands.where(F.col("evidence") == k).agg(F.min(c), F.max(c)).first() for k in (0, 1))
        assert low[0] is None or high[0] is None or not (low[1] < high[0] or high[1] < low[0])


@pytest.mark.skipif(not os.path.exists(MIDDLE), reason="needs the middle tables")
def test_held_out_quality(spark):
    """On whole tables that the models haven't seen."""
    auc = lambda df, p, y: R.auc(df.withColumn("k", F.monotonically_increasing_id()), p, y, "k").first().auc
    hands = plans.labelled_hands(spark, MIDDLE)
    assert auc(hands, "hand_p", "evidence") > 0.8
    assert auc(registry.QUERIES["evidence_stage_two"](spark, MIDDLE), "score", "evidence") > 0.85
    assert auc(registry.QUERIES["mil_rounds"](spark, MIDDLE), "p", "evidence") > 0.65
    assert auc(registry.QUERIES["logistic_baseline"](spark, MIDDLE), "p", "truth") > 0.6


def test_rounds_score_out_of_fold(spark, monkeypatch):
    calls = []
    real = L.out_of_fold
    monkeypatch.setattr(L, "out_of_fold", lambda df, *a: calls.append(df.columns) or real(df, *a))
    seen = L.pu_rounds(rows(spark), ["x", "z"])
    assert len(calls) == 3 and seen.count() == 600
    df = rows(spark, 120).withColumns({"bag": (F.col("id") / 10).cast("int"), "bag_label": ((F.col("id") / 10).cast("int") % 2).cast("int")})
    assert L.mil_rounds(df, "bag", ["x", "z"], "id", top=3).count() == 120 and len(calls) == 7


def test_rounds_fit_medians_and_scales_once_for_each_fold(spark, monkeypatch):
    fits = []
    real = L.Imputer.fit
    monkeypatch.setattr(L.Imputer, "fit", lambda self, *a: fits.append(1) or real(self, *a))
    df = rows(spark, 120).withColumns({"bag": (F.col("id") / 10).cast("int"), "bag_label": ((F.col("id") / 10).cast("int") % 2).cast("int")})
    assert L.mil_rounds(df, "bag", ["x", "z"], "id", top=3).count() == 120 and len(fits) == 3


@pytest.mark.parametrize(("part", "gaps"), [("", True), ("late", False)])
def test_hands_told_by_seats_alone(spark, small, monkeypatch, part, gaps):
    """Without cards the same rows as by way of all columns, and no card is valued for them; with ``gaps`` some seats' parts are missing."""
    monkeypatch.setattr(hands_of, "judged", lambda spark, d, log, part="": hands_of._judged(spark, d, log))
    if gaps:
        real = hands_of.T.table
        monkeypatch.setattr(hands_of.T, "table", lambda s, d, name: real(s, d, name).where("p_partkey % 5 <> 2") if name == "part" else real(s, d, name))
    made = {}
    for way, held in (("all", {"net_1"}), ("seats", hands_of.HELD)):
        monkeypatch.setattr(hands_of, "HELD", held)
        if way == "seats":
            monkeypatch.setattr(hands_of, "cards", None)
        made[way] = hands_of.pair_hands(spark, small, part=part, only=plans._named(plans.HAND, plans.MORE, plans.FAMILIES.values())).cache()
        assert made[way].count() > 50
    assert [(f.name, f.dataType) for f in made["all"].schema] == [(f.name, f.dataType) for f in made["seats"].schema]
    assert made["all"].exceptAll(made["seats"]).count() == 0 == made["seats"].exceptAll(made["all"]).count()


def test_early_features_see_no_later_action(spark, small, monkeypatch):
    monkeypatch.setattr(hands_of, "acts", hands_of._acts)
    monkeypatch.setattr(hands_of, "judged", lambda spark, d, log, part="": hands_of._judged(spark, d, log))
    real = plays.log
    before = plans.early_features(spark, small).cache()
    assert before.count() > 100
    late = F.col("street") >= 2
    other = lambda *a: real(*a).withColumns({"action": F.when(late, "raise").otherwise(F.col("action")), "amount": F.when(late, F.col("amount") + 7).otherwise(F.col("amount"))})
    monkeypatch.setattr(plays, "log", other)
    after = plans.early_features(spark, small)
    assert before.exceptAll(after).count() == 0 and after.exceptAll(before).count() == 0
    monkeypatch.setattr(plays, "log", lambda *a: real(*a).withColumn("action", F.when(~late, "raise").otherwise(F.col("action"))))
    assert before.exceptAll(plans.early_features(spark, small)).count() > 0  # and they do see the earlier ones


def test_the_rule_learns_from_other_folds_alone(spark):
    i = F.col("id")
    df = spark.range(90).select("id", (i % 3).cast("int").alias("fold"), F.when(i % 2 == 0, 0.0).otherwise(3.0).alias("pair_aggr"), F.lit(0.0).alias("pair_check"), F.lit(0.0).alias("n_pfr"), F.lit(0.0).alias("transfer_any"), F.lit(0.0).alias("surp_fold_sum"))
    df = df.withColumn("evidence", F.when(F.col("pair_aggr") == 0, 1).otherwise(0)).withColumn("evidence", F.when(F.col("fold") == 2, 0).otherwise(F.col("evidence")))
    got = {(r.fold, r.pair_aggr): r.rule_p for r in plans.by_rule(df).collect()}
    assert plans.by_rule(df).count() == 90
    # folds 0 and 1 have 15 positives of 30 each, fold 2 none: held out, fold 0 sees 15 of 60, 15 of 30 in its own cell
    assert got[0, 0.0] == pytest.approx((15 + 0.25) / 31) and got[0, 3.0] == pytest.approx(0.25 / 31)
    assert got[2, 0.0] == pytest.approx((30 + 0.5) / 31) and got[2, 3.0] == pytest.approx(0.5 / 31)
