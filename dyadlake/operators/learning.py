"""Models over MLlib: folds, positive-unlabelled rounds, multiple-instance rounds, bagging. All fits and scores are Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadlake.functions import expr as X
from dyadlake.operators import ranking as R
from dyadlake.sources import files


#: Ridge penalties that are tried.
PENALTIES = (0.01, 0.05, 0.2)


def logistic(features: Sequence[str], weight: str | None = None, classes: str = "auto", penalty: float = 0.01) -> Pipeline:
    """Median imputation, standardisation, logistic regression."""
    filled = [f"{c}__filled" for c in features]
    model = LogisticRegression(featuresCol="scaled", labelCol="label", family=classes, regParam=penalty, maxIter=20, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[Imputer(inputCols=list(features), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="vector"), StandardScaler(inputCol="vector", outputCol="scaled"), model])


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` and its features as ``vector``, for models that are fitted to the same features many times."""
    return VectorAssembler(inputCols=list(features), outputCol="vector").transform(df)


def boosted(features: Sequence[str], weight: str | None = None, seed: int = 7, subset: str = "all") -> Pipeline:
    """Boosted trees. ``subset``: which share of the features a node chooses from, by the seed. Without features the rows' own ``vector`` is taken."""
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=10, maxDepth=3, seed=seed, featureSubsetStrategy=subset, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[*([VectorAssembler(inputCols=list(features), outputCol="vector")] if features else []), model])


def forest(features: Sequence[str], seed: int = 7) -> Pipeline:
    """A random forest."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="vector"), RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=30, maxDepth=4, seed=seed)])


def probability(model: PipelineModel, df: DataFrame, name: str = "p", index: int = 1) -> DataFrame:
    """``df`` and the class probability as ``name``."""
    kept = [c for c in df.columns if c != name]
    return model.transform(df).select(*kept, vector_to_array("probability")[index].alias(name))


def out_of_fold(df: DataFrame, make: Callable[[], Pipeline], fold: str, folds: int, apply_to: DataFrame | None = None, before: dict[int, PipelineModel] | None = None) -> DataFrame:
    """Every row scored by the model fitted without its fold. ``apply_to``: other rows with a fold, scored by the same models. ``before``: keeps, by fold, what was fitted ahead of the last stage, for rounds over the same rows that change labels and weights alone. Without two classes to learn from, the score is the share of positives."""
    target = df if apply_to is None else apply_to
    sizes = {r[fold]: (r.n, r.y) for r in df.groupBy(fold).agg(F.count("*").alias("n"), F.sum("label").alias("y")).collect()}  # one row a fold
    parts = []
    for k in range(folds):
        n, y = (sum(v[i] for f, v in sizes.items() if f != k) for i in (0, 1))
        own = target.where(F.col(fold) == k)
        if 0 < y < n:
            others, made = df.where(F.col(fold) != k), make()
            if before is not None:
                if k not in before:
                    before[k] = Pipeline(stages=made.getStages()[:-1]).fit(others)
                made = Pipeline(stages=[before[k], made.getStages()[-1]])
            parts.append(probability(made.fit(others), own))
        else:  # nothing to learn from: the share of positives, if any row is there
            parts.append(own.drop("p").withColumn("p", F.lit(float(y / n) if n else 0.5)))
    return reduce(DataFrame.unionByName, parts)


def pu_rounds(df: DataFrame, features: Sequence[str], stages: Sequence[float] = (0.5, 0.25), fold: str = "fold", folds: int = 3) -> DataFrame:
    """Positive-unlabelled ranking, scored out of fold. ``known``: 1, 0 or null. Unlabelled rows start with weight 0.1; each further round takes those
    scoring above a quantile of the positives as positive with weight 1, and gives those below it but above the positives' 5 % one weight 0.2."""
    known, none = F.coalesce(F.col("known"), F.lit(0)).cast("double"), F.col("known").isNull()
    weight = F.when(F.col("known") == 1, 5.0).when(F.col("known") == 0, 1.0)
    rows = df.withColumns({"label": known, "w": weight.otherwise(0.1)})
    scored = files.stage(out_of_fold(rows, lambda: logistic(features, "w"), fold, folds))
    for q in stages:
        cuts = scored.where("known = 1").agg(F.percentile_approx("p", q).alias("cut"), F.percentile_approx("p", 0.05).alias("unsure"))
        again = scored.join(F.broadcast(cuts))
        likely, unsure = none & (F.col("p") >= F.col("cut")), none & (F.col("p") >= F.col("unsure"))
        again = again.withColumns({"label": F.when(likely, 1.0).otherwise(known), "w": weight.when(likely, 1.0).when(unsure, 0.2).otherwise(0.1)}).drop("cut", "unsure", "p")
        scored = files.stage(out_of_fold(again, lambda: logistic(features, "w"), fold, folds))
    return scored.drop("label", "w")


def mil_rounds(df: DataFrame, bag: str, features: Sequence[str], tie: str, rounds: int = 3, top: int = 8, folds: int = 3, fold: str | None = None) -> DataFrame:
    """Multiple-instance learning: a positive bag's best ``top`` rows are its positives, its others count little; repeated. All scores are of models
    that saw no row of the bag. ``fold``: a column of folds that holds whole bags (default: by the bag). Rounds change labels and weights alone, so medians and scales are worked out once."""
    rows = df.withColumns({"mil_fold": X.fold_of(bag, folds) if fold is None else F.col(fold), "label": F.col("bag_label").cast("double"), "w": F.when(F.col("bag_label") == 1, 0.3).otherwise(1.0)})
    make = lambda: logistic(features, "w")
    before: dict[int, PipelineModel] = {}
    rows = files.stage(out_of_fold(rows, make, "mil_fold", folds, None, before))
    for _ in range(rounds):
        place = F.row_number().over(Window.partitionBy(bag).orderBy(F.desc("p"), tie))
        rows = rows.withColumn("place", place).withColumns({"label": ((F.col("bag_label") == 1) & (F.col("place") <= top)).cast("double"), "w": F.when(F.col("bag_label") == 1, F.when(F.col("place") <= top, 1.0).otherwise(0.2)).otherwise(1.0)}).drop("place", "p")
        rows = files.stage(out_of_fold(files.stage(rows), make, "mil_fold", folds, None, before))
    return rows.drop("label", "w", "mil_fold")


def poisson(key: str, seed: int) -> Column:
    """A row's number of times in a seeded resample: a Poisson draw of mean 1 by a hash of its key, the same for every partitioning."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    return F.when(u < 0.367879, 0.0).when(u < 0.735759, 1.0).when(u < 0.919699, 2.0).when(u < 0.981012, 3.0).when(u < 0.99634, 4.0).otherwise(5.0)


def bagged(df: DataFrame, features: Sequence[str], seeds: Sequence[int], fold: str, folds: int, apply_to: DataFrame | None = None) -> DataFrame:
    """The mean out-of-fold probability of models on seeded resamples of the rows (by ``id``). ``apply_to``: the rows scored (default: the same)."""
    out = df if apply_to is None else apply_to
    own = out.columns
    for k, seed in enumerate(seeds):
        weighted = df.withColumn("w", poisson("id", seed)).where("w > 0")
        out = files.stage(out_of_fold(weighted, lambda: logistic(features, "w"), fold, folds, out).withColumnRenamed("p", f"__m{k}"))
    return out.select(*own, (sum((F.col(f"__m{k}") for k in range(len(seeds))), F.lit(0.0)) / len(seeds)).alias("p"))


def rank_share(df: DataFrame, score: str, tie: str) -> DataFrame:
    """``df`` with ``share``: 1 for the best row, down to 0."""
    n = df.agg(F.count("*").alias("__n"))
    return R.ranked(df, [], score, tie).join(F.broadcast(n)).withColumn("share", 1 - (F.col("place") - 1) / F.col("__n")).drop("place", "__n")
