"""Model queries: their results depend on a fit, so they have no oracle and are tested by their held-out quality.

Rows are pairs of players at a table and their hands (``plans/wide``). What a hand is evidence of (a dump, a checkdown, a squeeze) follows from who faced whom and
what was held. No feature is one of these columns, but some share a condition with them (how often the members raised or checked), so scores are partly told by definition; ``plans/boosted`` has labels from tables of their own. A pair is positive by its number of
such hands, and known for two pairs of three. Players stay at one table, and folds are whole tables, so no pair, player or hand is on both sides.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadlake.functions import expr as X
from dyadlake.operators import learning as L
from dyadlake.operators import ranking as R
from dyadlake.operators import wide as W
from dyadlake.plans import wide
from dyadlake.plans.registry import query
from dyadlake.sources import files

FOLDS = 3
FAMILIES = {"directed": "dump", "soft": "checkdown", "isolation": "squeeze"}
#: What the models see of a hand: none of it from the families that the labels come from, nor from what was held.
HAND = ("net_gap", "transfer_any", "transfer_pot_ratio", "opposite_net", "both_vpip", "both_post_in", "n_vpip", "n_pfr", "faced_raise_any", "pair_aggr", "pair_call", "pair_check", "pair_contrib", "pair_last_street", "surp_pair_sum", "surp_pair_max", "surp_fold_sum", "surp_raise_sum")
#: Further hypotheses: when the members acted, and how it departs from their own habits.
MORE = ("face_first", "active_last", "acts_sum_s0", "acts_sum_s3", "heads_up_s1", "heads_up_s2", "both_in_s3", "own_sum", "own_delta", "own_n_rare")
#: What they see of a pair: means, and how its hands score under a model of other tables' hands.
MEANS = ("pair_aggr",)
PAIR = (*(f"{c}_mean" for c in MEANS), "hand_mean", "hand_max", "hand_top3", "hand_sum")
POSITIVE = 3


def labelled_hands(spark: SparkSession, d: str) -> DataFrame:
    """Hands with features, what they are evidence of (directed, soft, isolation, any), their table's fold, and ``hand_p``: the evidence score of boosted trees fitted to the other tables' hands. A stage that all model queries share."""
    return files.once(spark, "labelled_hands", d, lambda: _labelled_hands(spark, d))


def _named(*names: Iterable[str]) -> list[str]:
    """The pair-hand columns behind some features: layers that none of them needs aren't joined."""
    return list(dict.fromkeys("opposite_net_sign" if c == "opposite_net" else c for some in names for c in some))


def _labelled_hands(spark: SparkSession, d: str) -> DataFrame:
    rows = wide.pair_hands(spark, d, only=_named(HAND, MORE, FAMILIES.values())).withColumn("opposite_net", F.col("opposite_net_sign"))
    flags = {k: F.col(c).cast("int") for k, c in FAMILIES.items()}
    some = F.greatest(*flags.values())
    double = [F.col(c).cast("double").alias(c) for c in (*HAND, *MORE)]
    rows = files.stage(L.assembled(rows.select("table_id", "hand_id", "p1", "p2", (F.col("p1") * 1000003 + F.col("p2")).alias("id"), *double, *[c.alias(k) for k, c in flags.items()], some.alias("evidence"), F.pmod("table_id", F.lit(FOLDS)).cast("int").alias("fold")), (*HAND, *MORE)))
    return L.out_of_fold(_label(rows, "evidence"), lambda: L.boosted(()), "fold", FOLDS).withColumnRenamed("p", "hand_p").drop("label", "vector")


#: What is known of a hand once its second street is over, besides ``HAND``.
EARLY = ("face_first", "active_last", "acts_sum_s0", "acts_sum_s1", "heads_up_s1", "own_sum", "own_delta", "own_n_rare")


def early_features(spark: SparkSession, d: str) -> DataFrame:
    """hand_id, table_id, p1, p2 and the features of the hands' first two streets, of pairs who both acted there; no later action has a part in them."""
    rows = wide.pair_hands(spark, d, part="early", only=_named(HAND, EARLY)).withColumn("opposite_net", F.col("opposite_net_sign"))
    return rows.select("hand_id", "table_id", "p1", "p2", *[F.col(c).cast("double").alias(c) for c in (*HAND, *EARLY)])


def foretold_hands(spark: SparkSession, d: str) -> DataFrame:
    """Hands with the features of their first two streets, ``evidence`` from the last two alone (0 if not both acted there), their table's fold, and ``hand_p`` by trees fitted to the other tables' hands; a stage."""
    return files.once(spark, "foretold_hands", d, lambda: _foretold_hands(spark, d))


def _foretold_hands(spark: SparkSession, d: str) -> DataFrame:
    late = wide.pair_hands(spark, d, part="late", only=_named(FAMILIES.values())).select("hand_id", "p1", "p2", F.greatest(*FAMILIES.values()).cast("int").alias("evidence"))
    rows = early_features(spark, d).join(late, ["hand_id", "p1", "p2"], "left").fillna(0, ["evidence"])
    rows = files.stage(rows.withColumn("fold", F.pmod("table_id", F.lit(FOLDS)).cast("int")))
    return L.out_of_fold(_label(rows, "evidence"), lambda: L.boosted((*HAND, *EARLY)), "fold", FOLDS).withColumnRenamed("p", "hand_p").drop("label")


def labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with features, ``truth`` (at least ``POSITIVE`` hands of evidence), ``known`` (the same for two pairs of three, else null), their commonest family, and the fold. A stage that all model queries share."""
    return files.once(spark, "labelled_pairs", d, lambda: _pairs(labelled_hands(spark, d)))


def _pairs(hands: DataFrame) -> DataFrame:
    counts = [F.sum(k).alias(f"n_{k}") for k in FAMILIES]
    best = F.row_number().over(Window.partitionBy("p1", "p2").orderBy(F.desc("hand_p"), "hand_id"))
    score = [F.avg("hand_p").alias("hand_mean"), F.max("hand_p").alias("hand_max"), F.avg(F.when(F.col("k") <= 3, F.col("hand_p"))).alias("hand_top3"), F.sum("hand_p").alias("hand_sum")]
    means = [F.avg(c).alias(f"{c}_mean") for c in dict.fromkeys((*MEANS, "opposite_net", "transfer_any"))]
    one = hands.withColumn("k", best).groupBy("table_id", "p1", "p2", "id", "fold").agg(F.count("*").cast("double").alias("n"), F.sum("evidence").alias("n_evidence"), *counts, *means, *score)
    truth = (F.col("n_evidence") >= POSITIVE).cast("int")
    family = F.array_max(F.array(*[F.struct(F.col(f"n_{k}").alias("n"), F.lit(k).alias("f")) for k in FAMILIES]))["f"]
    return one.withColumns({"truth": truth, "known": F.when(F.col("id") % 3 < 2, truth), "family": F.when(truth == 1, family).otherwise("none")}).drop("n_evidence", *[f"n_{k}" for k in FAMILIES])


def _label(df: DataFrame, column: str = "known") -> DataFrame:
    return df.withColumn("label", F.col(column).cast("double"))


def _logit(weight: str | None = None):
    return lambda: L.logistic(PAIR, weight, penalty=0.05)


def _scored(rows: DataFrame, make, weight: str | None = None) -> DataFrame:
    """Every pair scored by the model fitted to the known pairs of the other tables."""
    return L.out_of_fold(_label(rows.where("known is not null")), make, "fold", FOLDS, rows)


@query()
def policy_clone(spark: SparkSession, d: str) -> DataFrame:
    """The probability of the action that was taken, by a multinomial model of the situation, fitted to other tables."""
    log = wide.acts(spark, d)
    own = Window.partitionBy("hand_id", "player_id").orderBy("action_no")
    code = X.mapped("act", {"call": 0, "fold": 1, "raise": 2, "bet": 3, "check": 4}, 4)
    situation = {"street": F.col("street"), "facing": F.col("facing"), "action_no": F.col("action_no"), "active": F.col("active"), "spent": X.running_before("amount", own), "own_before": F.row_number().over(own) - 1, "partner_folded": (F.col("prev_act") == "fold").cast("int"), "raised": (F.col("prev_act") == "raise").cast("int")}
    rows = log.select("event_id", F.pmod("table_id", F.lit(FOLDS)).alias("fold"), code.cast("double").alias("label"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in situation.items()])
    rows = files.stage(rows)
    names = list(situation)
    parts = []
    for k in range(FOLDS):
        model = L.logistic(names, classes="multinomial").fit(rows.where(F.col("fold") != k))
        parts.append(model.transform(rows.where(F.col("fold") == k)).select("event_id", F.get(L.vector_to_array("probability"), F.col("label").cast("int")).alias("p")))
    return reduce(DataFrame.unionByName, parts).select("event_id", F.round("p", 6).alias("p"), F.round(X.surprise("p"), 6).alias("surprise"))


@query()
def logistic_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Median imputation, standardisation, logistic regression."""
    rows = labelled_pairs(spark, d)
    return _scored(rows, _logit()).select("p1", "p2", "known", "truth", F.round("p", 6).alias("p"))


def _two_seeds(rows: DataFrame, features: tuple[str, ...], label: str, weight: Column | None = None, among: str = "true") -> DataFrame:
    """``rows`` with ``p``: the mean of two seeds' out-of-fold boosted trees, fitted to the rows ``among`` which a condition holds."""
    rows = files.stage(L.assembled(_label(rows, label).withColumn("w", F.lit(1.0) if weight is None else weight), features))
    for seed in (7, 18):
        rows = L.out_of_fold(rows.where(among), lambda seed=seed: L.boosted((), "w", seed, "0.6"), "fold", FOLDS, rows).withColumnRenamed("p", f"p_{seed}")
        rows = files.stage(rows if seed == 7 else rows.drop("vector"))
    return rows.withColumn("p", (F.col("p_7") + F.col("p_18")) / 2).drop("p_7", "p_18", "label", "w")


def _known_hands(spark: SparkSession, d: str) -> DataFrame:
    return labelled_hands(spark, d).drop("hand_p").join(labelled_pairs(spark, d).select("p1", "p2", "known", "truth"), ["p1", "p2"]).where("known is not null")


@query()
def hand_ranker_oof(spark: SparkSession, d: str) -> DataFrame:
    """Every hand of a known pair scored without its table, twice, by the mean of two seeds' trees. ``p``: as evidence, by trees fitted to the hands of positive pairs.
    ``suspicion``: as a positive pair's evidence among the hands of all known pairs, to which the trees are fitted; such evidence weighs 8."""
    rows = _two_seeds(_known_hands(spark, d), HAND, "evidence", among="known = 1").withColumnRenamed("p", "as_evidence")
    found = F.col("known") * F.col("evidence")
    rows = _two_seeds(rows.withColumn("found", found), HAND, "found", F.when(found == 1, 8.0).otherwise(1.0))
    return rows.select("table_id", "p1", "p2", "hand_id", "fold", "known", "evidence", F.round("as_evidence", 6).alias("p"), F.round("p", 6).alias("suspicion"))


def _stage_one(spark: SparkSession, d: str) -> DataFrame:
    rows = files.stage(_known_hands(spark, d).where("known = 1"))
    return _two_seeds(rows, (*HAND, *MORE), "evidence")


@query()
def evidence_stage_one(spark: SparkSession, d: str) -> DataFrame:
    """The hands of positive pairs scored as evidence with the further hypotheses, without their table."""
    return _stage_one(spark, d).select("p1", "p2", "hand_id", "fold", "evidence", F.round("p", 6).alias("p"))


POOL = 20


@query()
def evidence_stage_two(spark: SparkSession, d: str) -> DataFrame:
    """The first stage's twenty best hands of each pair scored again by their place in that pool: 10 + the second score, the others keep the first."""
    rows = _stage_one(spark, d).withColumnRenamed("p", "first")
    best = Window.partitionBy("p1", "p2").orderBy(F.desc("first"), "hand_id")
    pair = Window.partitionBy("p1", "p2")
    rows = files.stage(rows.withColumn("k", F.row_number().over(best)))
    pool = rows.where(F.col("k") <= POOL)
    relative = {
        "place": F.col("k").cast("double"), "to_best": F.col("first") / (F.max("first").over(pair) + 1e-6), "below": F.coalesce(F.lag("first").over(best) - F.col("first"), F.lit(0.0)), "share": F.col("first") / (F.sum("first").over(pair) + 1e-6), "pool": F.count("*").over(pair).cast("double"),
        **{f"{c}_max": X.ratio_to_max(c, ["p1", "p2"]) for c in ("transfer_any", "pair_contrib", "surp_pair_sum")}, **{f"{c}_z": X.z_score(c, ["p1", "p2"]) for c in ("net_gap", "pair_check", "pair_aggr")},
    }
    pool = files.stage(_label(pool.withColumns(relative), "evidence"))
    second = L.out_of_fold(pool, lambda: L.boosted((*relative, "first", *HAND), None, 7, "0.6"), "fold", FOLDS).select("p1", "p2", "hand_id", F.col("p").alias("second"))
    both = rows.join(second, ["p1", "p2", "hand_id"], "left")
    return both.select("p1", "p2", "hand_id", "fold", "evidence", F.round("first", 6).alias("first"), F.round(F.coalesce(10 + F.col("second"), F.col("first")), 6).alias("score"))


@query()
def leave_table_out(spark: SparkSession, d: str) -> DataFrame:
    """Unlabelled pairs of every table scored by the model fitted without the table."""
    rows = labelled_pairs(spark, d)
    return L.out_of_fold(_label(rows.where("known is not null")), _logit(), "fold", FOLDS, rows.where("known is null")).select("table_id", "p1", "p2", "fold", "truth", F.round("p", 6).alias("p"))


@query()
def pu_three_stage(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds of positive-unlabelled ranking, with few known negatives."""
    rows = labelled_pairs(spark, d)
    some = rows.withColumn("known", F.when((F.col("known") == 1) | (F.col("id") % 5 == 0), F.col("known")))
    return L.pu_rounds(some, PAIR, folds=FOLDS).select("p1", "p2", "known", "truth", F.round("p", 6).alias("p"))


SCHEMES = {"plain": (2.0, 1.0, 0.35), "steep": (5.0, 1.0, 0.1), "soft": (1.0, 0.22, 0.12)}


@query()
def weight_schemes(spark: SparkSession, d: str) -> DataFrame:
    """Positives, negatives and unlabelled pairs weighed in three ways, each fed to a fit."""
    rows = labelled_pairs(spark, d)
    out = rows
    for name, (pos, neg, none) in SCHEMES.items():
        weighted = rows.withColumns({"label": F.coalesce("known", F.lit(0)).cast("double"), "w": F.when(F.col("known") == 1, pos).when(F.col("known") == 0, neg).otherwise(none)})
        p = L.out_of_fold(weighted, _logit("w"), "fold", FOLDS).select("p1", "p2", F.round("p", 6).alias(name))
        out = files.stage(out.join(p, ["p1", "p2"]))
    return out.select("p1", "p2", "known", "truth", *SCHEMES)


def _heads(rows: DataFrame) -> DataFrame:
    """``rows`` with one-vs-rest scores and priors of the families, out of fold."""
    known = rows.where("known is not null")
    for k in FAMILIES:
        prior = known.agg(F.greatest(F.avg((F.col("family") == k).cast("int")), F.lit(0.01)).alias(f"prior_{k}"))
        one = known.withColumn("label", (F.col("family") == k).cast("double"))
        p = L.out_of_fold(one, _logit(), "fold", FOLDS, rows).select("p1", "p2", F.col("p").alias(k))
        rows = files.stage(rows.join(p, ["p1", "p2"]).join(F.broadcast(prior)))
    return rows


def _family() -> Column:
    return F.array_max(F.array(*[F.struct((F.col(k) / F.col(f"prior_{k}")).alias("v"), F.lit(k).alias("f")) for k in FAMILIES]))["f"]


@query()
def family_heads(spark: SparkSession, d: str) -> DataFrame:
    """One-vs-rest heads; the family with the largest p / prior among likely pairs, none elsewhere."""
    rows = _heads(_scored(labelled_pairs(spark, d), _logit()).withColumnRenamed("p", "risk"))
    return rows.select("p1", "p2", "known", F.col("family").alias("true_family"), F.when(F.col("risk") >= 0.5, _family()).otherwise("none").alias("family"), *[F.round(k, 6).alias(f"p_{k}") for k in FAMILIES])


@query()
def two_stage_risk(spark: SparkSession, d: str) -> DataFrame:
    """First the risk, then the family: below 0.45 none, and other where no family is likely."""
    rows = _heads(_scored(labelled_pairs(spark, d), _logit()).withColumnRenamed("p", "risk"))
    return rows.select("p1", "p2", "truth", F.round("risk", 6).alias("risk"), F.when(F.col("risk") < 0.45, "none").when(F.greatest(*FAMILIES) < 0.4, "other").otherwise(_family()).alias("family"))


@query()
def mil_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Hands ranked within pairs that are only labelled as a whole; folds are whole tables."""
    hands = labelled_hands(spark, d)
    bags = labelled_pairs(spark, d).select("p1", "p2", F.col("truth").alias("bag_label"))
    rows = files.stage(hands.join(bags, ["p1", "p2"]).select(F.col("id").alias("bag"), "bag_label", "hand_id", "evidence", "fold", *HAND))
    scored = L.mil_rounds(rows, "bag", HAND, "hand_id", top=4, fold="fold", folds=FOLDS)
    return scored.select("bag", "bag_label", "hand_id", "evidence", F.round("p", 6).alias("p"))


@query()
def transductive_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Unlabelled pairs take the labels of confident scores, twice, and the model is fitted again; all scores are of other tables' models."""
    rows = labelled_pairs(spark, d)
    scored = files.stage(_scored(rows, _logit()))
    for _ in range(2):
        sure = F.when(F.col("p") >= 0.9, 1.0).when(F.col("p") <= 0.1, 0.0)
        again = scored.withColumns({"label": F.coalesce(F.col("known").cast("double"), sure), "w": F.when(F.col("known").isNotNull(), 1.0).otherwise(0.3)}).drop("p")
        scored = files.stage(L.out_of_fold(again.where("label is not null"), _logit("w"), "fold", FOLDS, again))
    return scored.select("p1", "p2", "known", "truth", F.round("p", 6).alias("p"))


@query()
def seed_bag(spark: SparkSession, d: str) -> DataFrame:
    """The blend of a bag of models and a heuristic by rank shares, .70 and .30; each model sees the known pairs of the other tables, resampled."""
    rows = labelled_pairs(spark, d)
    bag = files.stage(L.bagged(_label(rows.where("known is not null")), PAIR, range(5), "fold", FOLDS, rows))
    model = L.rank_share(bag, "p", "id").withColumnRenamed("share", "model")
    both = L.rank_share(model, "transfer_any_mean", "id")
    return both.select("p1", "p2", "truth", F.round("p", 6).alias("p"), F.round(0.7 * F.col("model") + 0.3 * F.col("share"), 9).alias("blend"))


def _learners(rows: DataFrame) -> DataFrame:
    """``rows`` with the out-of-fold scores of three learners: boosted, forest, logistic."""
    makes = {"boosted": lambda: L.boosted(PAIR, None, 7, "0.6"), "forest": lambda: L.forest(PAIR), "logistic": _logit()}
    out = rows
    for name, make in makes.items():
        out = files.stage(out.join(_scored(rows, make).select("p1", "p2", F.col("p").alias(name)), ["p1", "p2"]))
    return out


@query()
def triple_blend(spark: SparkSession, d: str) -> DataFrame:
    """Three learners, .40, .35 and .25, and the family heads' strongest."""
    rows = _heads(_learners(labelled_pairs(spark, d)))
    blend = 0.4 * F.col("boosted") + 0.35 * F.col("forest") + 0.25 * F.col("logistic")
    return rows.select("p1", "p2", "truth", F.round(blend, 6).alias("blend"), F.round(F.greatest(*FAMILIES), 6).alias("head"), F.round(0.9 * blend + 0.1 * F.greatest(*FAMILIES), 6).alias("score"))


@query()
def specialist_mix(spark: SparkSession, d: str) -> DataFrame:
    """For each family .6 of its head and .4 of the global model, the head itself .8 trees' mean and .2 logistic."""
    rows = _heads(_learners(labelled_pairs(spark, d)))
    general = 0.8 * (F.col("boosted") + F.col("forest")) / 2 + 0.2 * F.col("logistic")
    return rows.select("p1", "p2", "truth", F.col("family").alias("true_family"), *[F.round(0.6 * F.col(k) + 0.4 * general, 6).alias(k) for k in FAMILIES])


ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)


@query()
def clean_label_branch(spark: SparkSession, d: str) -> DataFrame:
    """A branch that learns from clean negatives alone (pairs with no one-sided transfer), blended by ranks within folds. The share of it is the smallest whose worst fold is within 0.002 of the best such."""
    rows = _scored(labelled_pairs(spark, d), _logit()).withColumnRenamed("p", "plain")
    clean = rows.where((F.col("known") == 1) | (F.col("known") == 0) & (F.col("opposite_net_mean") <= 0.5))
    both = files.stage(L.out_of_fold(_label(clean), _logit(), "fold", FOLDS, rows).withColumnRenamed("p", "clean"))
    for c in ("plain", "clean"):
        both = R.average_rank_share(both, ["fold"], c, f"{c}_rank", "id")
    both = files.stage(both)
    worst = []
    for a in ALPHAS:
        mixed = both.where("known is not null").withColumn("s", a * F.col("clean_rank") + (1 - a) * F.col("plain_rank"))
        worst.append(R.average_precision(mixed, ["fold"], "s", "known", "id").agg(F.lit(a).alias("alpha"), F.min("ap").alias("ap")))
    grid = reduce(DataFrame.unionByName, worst)
    grid = grid.withColumn("best", F.max("ap").over(Window.partitionBy(F.lit(0))))  # a handful of rows
    alpha = grid.where("ap >= best - 0.002").agg(F.min("alpha").alias("alpha"))
    return both.join(F.broadcast(alpha)).select("p1", "p2", "known", "truth", "alpha", F.round(F.col("alpha") * F.col("clean_rank") + (1 - F.col("alpha")) * F.col("plain_rank"), 9).alias("blend"))


@query()
def gated_blend(spark: SparkSession, d: str) -> DataFrame:
    """The three learners' blend takes the logistic model's place only if it gains at least .0015 of average precision on the known pairs."""
    rows = _learners(labelled_pairs(spark, d)).withColumn("blend", 0.4 * F.col("boosted") + 0.35 * F.col("forest") + 0.25 * F.col("logistic"))
    known = rows.where("known is not null")
    ap = {c: R.average_precision(known, [], c, "known", "id").select(F.col("ap").alias(f"ap_{c}")) for c in ("logistic", "blend")}
    both = rows.join(F.broadcast(ap["logistic"])).join(F.broadcast(ap["blend"]))
    gain = F.col("ap_blend") - F.col("ap_logistic")
    return both.select("p1", "p2", "truth", F.round(gain, 6).alias("gain"), F.round(F.when(gain >= 0.0015, F.col("blend")).otherwise(F.col("logistic")), 6).alias("score"))


@query()
def strict_nested(spark: SparkSession, d: str) -> DataFrame:
    """For every table fold: models with three penalties fitted inside, the best chosen on one inner fold, fitted again to all but the outer fold, and its threshold taken from the inner fold alone."""
    rows = labelled_pairs(spark, d)
    known = _label(rows.where("known is not null"))
    parts = []
    for k in range(FOLDS):
        tune = (k + 1) % FOLDS
        fit, held = known.where(~F.col("fold").isin(k, tune)), known.where(F.col("fold") == tune)
        tried = [files.stage(L.probability(L.logistic(PAIR, penalty=c).fit(fit), held).withColumn("penalty", F.lit(c))) for c in L.PENALTIES]
        ap = reduce(DataFrame.unionByName, [R.average_precision(t, [], "p", "known", "id").select(F.lit(c).alias("penalty"), F.coalesce("ap", F.lit(0.0)).alias("ap")) for t, c in zip(tried, L.PENALTIES, strict=True)])
        chosen = ap.orderBy(F.desc("ap"), "penalty").first().penalty  # three rows
        cut = tried[L.PENALTIES.index(chosen)].where("known = 1").agg(F.percentile_approx("p", 0.25).alias("cut"))
        model = L.logistic(PAIR, penalty=chosen).fit(known.where(F.col("fold") != k))
        parts.append(L.probability(model, rows.where(F.col("fold") == k)).join(F.broadcast(cut)).withColumn("penalty", F.lit(chosen)))
    both = reduce(DataFrame.unionByName, parts)
    return both.select("p1", "p2", "fold", "known", "truth", "penalty", F.round("p", 6).alias("p"), (F.col("p") >= F.col("cut")).cast("int").alias("acted_on"))


@query()
def early_to_late(spark: SparkSession, d: str) -> DataFrame:
    """A pseudo-future: features of each pair's first 70 % of hands, the label of the rest."""
    hands = labelled_hands(spark, d)
    w = Window.partitionBy("p1", "p2")
    hands = hands.withColumn("early", F.row_number().over(w.orderBy("hand_id")) / F.count("*").over(w) <= 0.7)
    late = hands.where(~F.col("early")).groupBy("p1", "p2").agg(F.max("evidence").alias("later"))
    rows = files.stage(_pairs(hands.where("early")).join(late, ["p1", "p2"]).withColumns({"known": F.col("later"), "truth": F.col("later")}))
    return _scored(rows, _logit()).select("p1", "p2", "truth", F.round("p", 6).alias("p"))


#: The conditions that the labels' own definitions name, as far as features show them; they part hands into a few dozen cells.
RULE = ("pair_aggr = 0", "pair_aggr >= 2", "n_pfr >= 2", "pair_check >= 2", "transfer_any > 0", "surp_fold_sum > 0")


def by_rule(hands: DataFrame) -> DataFrame:
    """``hands`` with ``rule_p``: the share of evidence among the other folds' hands in the same cell of ``RULE``, of which one more is taken to be as common as among all of them."""
    hands = hands.withColumn("cell", sum((F.expr(f"CAST({c} AS INT) * {1 << k}") for k, c in enumerate(RULE)), F.lit(0)))
    counts = hands.groupBy("cell", "fold").agg(F.sum("evidence").alias("y"), F.count("*").alias("n"))  # cells x folds
    cells, others = counts.select("cell").distinct(), counts.select(F.col("fold").alias("of"), F.col("cell").alias("at"), "y", "n")
    held = counts.select("fold").distinct().join(others, F.col("fold") != F.col("of"))
    whole = held.groupBy("fold").agg((F.sum("y") / F.sum("n")).alias("prior"))
    own = held.groupBy("fold", F.col("at").alias("cell")).agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    table = whole.join(F.broadcast(cells)).join(own, ["fold", "cell"], "left").fillna(0, ["y", "n"])
    table = table.select("fold", "cell", ((F.col("y") + F.col("prior")) / (F.col("n") + 1)).alias("rule_p"))
    return hands.join(F.broadcast(table), ["fold", "cell"], "left").fillna(0.0, ["rule_p"]).drop("cell")


@query()
def held_out_report(spark: SparkSession, d: str) -> DataFrame:
    """How well hands of other tables are scored, by the trees and by the look-up of ``RULE``: where the label is of the whole hand (and features share its conditions), and where features are of the first two streets and the label of the last two."""
    out = []
    for labels, rows in (("whole hand", labelled_hands(spark, d)), ("last streets", foretold_hands(spark, d))):
        rows = files.stage(by_rule(rows.withColumn("row", F.xxhash64("hand_id", "p1", "p2"))))
        size = rows.agg(F.count("*").alias("n"), F.sum("evidence").alias("positives"))
        for scorer, p in (("trees", "hand_p"), ("rule", "rule_p")):
            figures = R.auc(rows, p, "evidence", "row").select("auc").join(R.average_precision(rows, [], p, "evidence", "row").select("ap")).join(size)  # one row each
            out.append(figures.select(F.lit(labels).alias("labels"), F.lit(scorer).alias("scorer"), "n", "positives", F.round("auc", 6).alias("auc"), F.round("ap", 6).alias("ap")))
    return reduce(DataFrame.unionByName, out)


@query()
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    """What the boosted trees of all folds split on, on average."""
    rows = _label(labelled_pairs(spark, d).where("known is not null"))
    parts = []
    for k in range(FOLDS):
        trees = L.boosted(PAIR, None, 7, "0.6").fit(rows.where(F.col("fold") != k)).stages[-1]
        parts += [(k, f, float(v)) for f, v in zip(PAIR, trees.featureImportances.toArray(), strict=True)]  # features x folds
    one = spark.createDataFrame(parts, "fold int, feature string, importance double").groupBy("feature").agg(F.round(F.avg("importance"), 6).alias("importance"), F.round(F.stddev_samp("importance"), 6).alias("spread"))
    return one.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
