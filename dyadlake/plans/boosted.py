"""Model queries on labels that stand in a table of their own: whether a document is of low quality (``labels``) and what an embedding shows (``embeddings``). No feature is made of a label, nor a label of features.

A source stands for a table of players, its documents for hands: folds are whole sources. Features are statistics of the texts, or the vectors' coordinates. For the action log's clone, whose actions follow from nothing in the tables, early stopping keeps next to no round: its loss is that of the actions' shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadlake.functions import expr as X
from dyadlake.operators import boosting as B
from dyadlake.plans import wide
from dyadlake.plans.registry import query
from dyadlake.sources import files
from dyadlake.sources import tables as T

FOLDS = 3
ROUNDS = 8


def _share(pattern: str, text: Column, n: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / n


def text_features(text: Column) -> dict[str, Column]:
    """What a text looks like, without its words: lengths, kinds of characters, repetition."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    m = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.split(text, "\n")
    return {
        "chars": F.length(text).cast("double"), "words": F.size(words).cast("double"), "word_length": F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / m, "longest": F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).cast("double"), "distinct": F.size(F.array_distinct(words)) / m,
        "digits": _share("[0-9]", text, n), "upper": _share("[A-Z]", text, n), "stops": _share("[.!?]", text, n), "commas": _share("[,;:]", text, n), "marks": _share(r"[^\p{L}\p{N}\s.,;:!?]", text, n), "accents": _share("[^\\x00-\\x7F]", text, n),
        "lines": F.size(lines).cast("double"), "repeated_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines).cast("double"), "short": F.size(F.filter(words, lambda w: F.length(w) <= 2)) / m,
    }


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with features, ``label`` (1: low quality), ``toxic``, and the fold of their source; a stage."""

    def make() -> DataFrame:
        known = T.table(spark, d, "labels").where("quality is not null")
        docs = T.table(spark, d, "documents").join(known, "doc_id")
        return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), _source_fold().alias("fold"), (1 - F.col("quality")).alias("label"), "toxic", *[c.alias(k) for k, c in text_features(F.coalesce("text", F.lit(""))).items()])

    return files.once(spark, "judged_documents", d, make)


def _source_fold() -> Column:
    """Whole sources, as nothing that is learned from one may be scored on it."""
    return F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(FOLDS)).cast("int")


#: What the models see. Sentence marks and capitals are left out: in these tables they alone tell low quality, and nothing would be left to learn.
TEXT = ["chars", "words", "word_length", "longest", "distinct", "digits", "marks", "accents", "lines", "repeated_lines", "short"]


@query()
def pairwise_ranker(spark: SparkSession, d: str) -> DataFrame:
    """Within every source, documents of low quality ranked first: by trees that learn from pairs of one source (``score``) and by the pointwise first stage (``p``), both from other sources alone."""
    rows = judged(spark, d)
    first = B.out_of_fold(rows, TEXT, FOLDS, "doc_id", rounds=ROUNDS).select("doc_id", "p")
    ranked = B.out_of_fold(rows, TEXT, FOLDS, "doc_id", name="score", objective="pairwise", group="source", rounds=ROUNDS)
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id"))
    out = ranked.join(first, "doc_id").select("doc_id", "source", "fold", "label", F.round("p", 6).alias("p"), F.round("score", 6).alias("score"))
    return out.withColumn("place", place)


@query()
def early_stopped(spark: SparkSession, d: str) -> DataFrame:
    """Low quality by trees refitted with the median of the inner folds' best numbers of rounds; the outer fold is neither learned from nor watched."""
    rows = judged(spark, d)
    model, stopped, chosen = B.nested(rows, TEXT, FOLDS, "doc_id", rounds=12, rate=0.5, patience=2)
    by_fold = F.create_map(*[x for k in range(FOLDS) for x in (F.lit(k), F.struct(F.lit(chosen[k]).alias("rounds"), F.array(*map(F.lit, stopped[k])).alias("inner")))])
    out = B.score(rows, model, {k: k for k in range(FOLDS)}).withColumn("chosen", by_fold[F.col("fold")])
    risk = F.when(F.col("p") < 0.45, "none").otherwise("low quality")
    return out.select("doc_id", "fold", "label", F.col("chosen.rounds").alias("rounds"), F.array_join("chosen.inner", ",").alias("inner_rounds"), F.round("p", 6).alias("p"), risk.alias("verdict"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query()
def softmax_languages(spark: SparkSession, d: str) -> DataFrame:
    """The probability of every document's language by softmax boosting over 32 shares of letters, learned from other sources."""
    text = F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 1 << 30))
    docs = T.table(spark, d, "documents").where("lang is not null")
    codes = docs.select("lang").distinct()
    most = codes.count()  # languages, a column of few values
    number = codes.orderBy("lang").limit(64).agg(F.sort_array(F.collect_list("lang")).alias("langs"))
    n = F.greatest(F.length("low"), F.lit(1))
    shares = {f"letter_{c}": (F.length("low") - F.length(F.translate("low", c, ""))) / n for c in LETTERS}
    further = {"accents": _share("[^\\x00-\\x7F]", F.col("low"), n), "spaces": (F.length("low") - F.length(F.translate("low", " ", ""))) / n, "vowels": _share("[aeiou]", F.col("low"), n), "doubled": _share(r"(\p{L})\1", F.col("low"), n), "ends": _share(r"[aeiou]\b", F.col("low"), n), "marks": _share("[.,;:!?]", F.col("low"), n)}
    rows = docs.select("doc_id", "lang", _source_fold().alias("fold"), text.alias("low")).join(F.broadcast(number)).withColumn("label", F.array_position("langs", F.col("lang")) - 1)
    rows = files.stage(rows.select("doc_id", "lang", "fold", "label", "langs", *[c.cast("double").alias(k) for k, c in {**shares, **further}.items()]))
    out = B.out_of_fold(rows, [*shares, *further], FOLDS, "doc_id", objective="softmax", classes=most, rounds=6)
    best = F.get("langs", (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    return out.select("doc_id", "lang", best.alias("predicted"), F.round(F.get("p", F.col("label").cast("int")), 6).alias("p_lang"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


ACTIONS = ("bet", "call", "check", "fold", "raise")


@query()
def softmax_clone(spark: SparkSession, d: str) -> DataFrame:
    """The probability of the action that was taken, over all actions, by softmax boosting of 32 columns of the situation; rounds stop early on the next fold's tables, which the outer fold is no part of."""
    log = wide.acts(spark, d)
    own, hand = Window.partitionBy("hand_id", "player_id").orderBy("action_no"), Window.partitionBy("hand_id").orderBy("action_no")
    is_ = lambda a: (F.col("act") == a).cast("int")
    situation = {
        "street": F.col("street"), "facing": F.col("facing"), "action_no": F.col("action_no"), "active": F.col("active"), "spent": X.running_before("amount", own), "pot": X.running_before("amount", hand), "own_before": F.row_number().over(own) - 1, "seat": F.pmod("player_id", F.lit(6)), "folds_before": F.col("folds_before"),
        "gap": F.pmod(F.col("player_id") - F.coalesce("prev_player", F.col("player_id")), F.lit(6)), "last_amount": F.lag("amount").over(hand), "own_last_amount": F.lag("amount").over(own),
        **{f"prev_{a}": (F.col("prev_act") == a).cast("int") for a in ACTIONS}, **{f"own_{a}": X.running_before(is_(a), own) for a in ACTIONS}, **{f"hand_{a}": X.running_before(is_(a), hand) for a in ACTIONS}, **{f"own_prev_{a}": (F.lag("act").over(own) == a).cast("int") for a in ACTIONS},
    }
    label = X.mapped("act", {a: k for k, a in enumerate(ACTIONS)}, 0)
    rows = files.stage(log.select("event_id", "act", F.pmod("table_id", F.lit(FOLDS)).cast("int").alias("fold"), label.alias("label"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in situation.items()]))
    everything = frozenset(range(FOLDS))
    fits = [B.Fit(everything - {k, (k + 1) % FOLDS}, frozenset({(k + 1) % FOLDS})) for k in range(FOLDS)]
    model = B.fit(rows, list(situation), fits, "event_id", objective="softmax", classes=len(ACTIONS), rounds=4, depth=2, rate=0.1, patience=2)
    out = B.score(rows, model, {k: k for k in range(FOLDS)})
    taken = F.get("p", F.col("label"))
    return out.select("event_id", "act", *[F.round(F.get("p", F.lit(k)), 6).alias(f"p_{a}") for k, a in enumerate(ACTIONS)], F.round(X.surprise(taken), 6).alias("surprise"))
