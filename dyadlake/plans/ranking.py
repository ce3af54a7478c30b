"""Ranking metrics and decisions over labelled documents, scored by arithmetic on their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadlake.operators import ranking as R
from dyadlake.plans.registry import query
from dyadlake.sources import tables as T

_SCORED = "scored AS (SELECT l.doc_id, lang, \"source\", toxic, quality, (l.doc_id * 7919 + 17) % 1009 score, (l.doc_id * 104729 + 5) % 997 other, 1 + l.doc_id % 3 weight FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with two scores (ties occur) and a weight."""
    k = F.col("doc_id")
    docs = T.table(spark, d, "documents").select("doc_id", "lang", "source")
    return T.table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "lang", "source", "toxic", "quality", F.pmod(k * 7919 + 17, F.lit(1009)).alias("score"), F.pmod(k * 104729 + 5, F.lit(997)).alias("other"), (1 + k % 3).alias("weight"))


_ORDERED = "row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) place, sum(toxic) OVER (PARTITION BY lang ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) hits"


@query(f"SELECT lang, round(sum(toxic * hits / place) / nullif(sum(toxic), 0), 9) ap FROM (SELECT *, {_ORDERED} FROM scored) GROUP BY 1", also=_SCORED)
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return R.average_precision(scored(spark, d), ["lang"], "score", "toxic", "doc_id").select("lang", F.round("ap", 9).alias("ap"))


@query("SELECT round(sum(toxic * weight * m / w) / sum(toxic * weight), 9) ap FROM (SELECT *, sum(toxic * weight) OVER o m, sum(weight) OVER o w FROM scored WINDOW o AS (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING))", also=_SCORED)
def weighted_ap(spark: SparkSession, d: str) -> DataFrame:
    return R.weighted_average_precision(scored(spark, d), [], "score", "toxic", "weight", "doc_id").select(F.round("ap", 9).alias("ap"))


_MAP5 = "map5 AS (SELECT \"source\", sum(CASE WHEN place <= 5 THEN toxic * hits / place ELSE 0 END) / least(sum(toxic), 5) ap FROM (SELECT *, row_number() OVER o place, sum(toxic) OVER (PARTITION BY \"source\" ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) hits FROM scored WINDOW o AS (PARTITION BY \"source\" ORDER BY score DESC, doc_id)) GROUP BY 1 HAVING sum(toxic) > 0)"


@query("SELECT \"source\", round(ap, 9) ap FROM map5", also=f"{_SCORED}, {_MAP5}")
def map_at_5(spark: SparkSession, d: str) -> DataFrame:
    return R.map_at(scored(spark, d), "source", "score", "toxic", "doc_id").select("source", F.round("ap", 9).alias("ap"))


_FAMILY = "family AS (SELECT f, coalesce(sum(y * hits / place) / nullif(sum(y), 0), 0) ap FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY s DESC, doc_id) place, sum(y) OVER (PARTITION BY f ORDER BY s DESC, doc_id ROWS UNBOUNDED PRECEDING) hits FROM (SELECT doc_id, f, CASE WHEN lang = f AND toxic = 1 THEN 1 ELSE 0 END y, CASE WHEN lang = f THEN score ELSE 0 END s FROM scored, (SELECT DISTINCT lang AS f FROM scored WHERE lang IS NOT NULL))) GROUP BY 1)"


@query("SELECT f AS family, round(ap, 9) ap FROM family", also=f"{_SCORED}, {_FAMILY}")
def behaviour_map(spark: SparkSession, d: str) -> DataFrame:
    """Average precision by family; a row's score counts only for its own."""
    return by_family(scored(spark, d)).select("family", F.round("ap", 9).alias("ap"))


def by_family(rows: DataFrame) -> DataFrame:
    """Average precision of every family that occurs: a row without one counts for none."""
    own = F.coalesce(F.col("lang") == F.col("family"), F.lit(False))
    families = rows.agg(F.collect_set("lang").alias("families"))  # one row of a few values
    each = rows.join(F.broadcast(families)).withColumn("family", F.explode("families")).select("doc_id", "family", (own & (F.col("toxic") == 1)).cast("int").alias("y"), F.when(own, F.col("score")).otherwise(0).alias("s"))
    return R.average_precision(each, ["family"], "s", "y", "doc_id").fillna(0.0, ["ap"])


@query(
    "SELECT round(0.7 * (SELECT sum(toxic * hits / place) / sum(toxic) FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) place, sum(toxic) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) hits FROM scored)) + 0.2 * (SELECT avg(ap) FROM map5) + 0.1 * (SELECT avg(ap) FROM family), 9) AS composite",
    also=f"{_SCORED}, {_MAP5}, {_FAMILY}",
)
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    """0.7 average precision + 0.2 mean AP@5 + 0.1 mean family AP."""
    rows = scored(spark, d)
    parts = R.average_precision(rows, [], "score", "toxic", "doc_id").select((0.7 * F.col("ap")).alias("x"))
    parts = parts.union(R.map_at(rows, "source", "score", "toxic", "doc_id").agg(0.2 * F.avg("ap"))).union(by_family(rows).agg(0.1 * F.avg("ap")))
    return parts.agg(F.round(F.sum("x"), 9).alias("composite"))


@query("SELECT round((sum(r * toxic) - sum(toxic) * (sum(toxic) + 1) / 2) / (sum(toxic) * (count(*) - sum(toxic))), 9) auc FROM (SELECT toxic, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 r FROM scored)", also=_SCORED)
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    return R.auc(scored(spark, d), "score", "toxic", "doc_id").select(F.round("auc", 9).alias("auc"))


@query("SELECT round(corr(a, b), 9) rho FROM (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 a, rank() OVER (ORDER BY other) + (count(*) OVER (PARTITION BY other) - 1) / 2 b FROM scored)", also=_SCORED)
def spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of two scores."""
    r = R.average_ranks(R.average_ranks(scored(spark, d), "score", "a", "doc_id"), "other", "b", "doc_id")
    return r.agg(F.round(F.corr("a", "b"), 9).alias("rho"))


@query("SELECT k, round(avg(p), 9) AS precision FROM (SELECT \"source\", k, avg(toxic) p FROM (SELECT *, row_number() OVER (PARTITION BY \"source\" ORDER BY score DESC, doc_id) place FROM scored), (VALUES (1), (2), (3), (4), (5)) v(k) WHERE place <= k GROUP BY 1, 2) GROUP BY 1", also=_SCORED)
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    top = scored(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 5")
    each = top.withColumn("k", F.explode(F.sequence(F.col("place"), F.lit(5)))).groupBy("source", "k").agg(F.avg("toxic").alias("p"))
    return each.groupBy("k").agg(F.round(F.avg("p"), 9).alias("precision"))


@query("SELECT lang, round(avg(-ln(CASE WHEN toxic = 1 THEN p ELSE 1 - p END)), 9) loss FROM (SELECT lang, toxic, least(greatest(score / 1009.0, 1e-5), 1 - 1e-5) p FROM scored) GROUP BY 1", also=_SCORED)
def log_loss(spark: SparkSession, d: str) -> DataFrame:
    p = F.least(F.greatest(F.col("score") / 1009.0, F.lit(1e-5)), F.lit(1 - 1e-5))
    return scored(spark, d).groupBy("lang").agg(F.round(F.avg(-F.log(F.when(F.col("toxic") == 1, p).otherwise(1 - p))), 9).alias("loss"))


@query("SELECT toxic, CASE WHEN score >= 500 THEN 1 ELSE 0 END predicted, count(*) n FROM scored GROUP BY 1, 2", also=_SCORED)
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("toxic", (F.col("score") >= 500).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


@query(
    "SELECT draw, round(sum(toxic * w) / sum(w), 9) rate FROM (SELECT toxic, draw, (doc_id * 31 + draw * 7919 + doc_id * draw) % 3 w FROM scored, (SELECT unnest(range(200)) draw)) GROUP BY 1", also=_SCORED
)
def bootstrap_draws(spark: SparkSession, d: str) -> DataFrame:
    """A statistic over reweighted rows; the weights are arithmetic, so draws don't depend on the partitioning."""
    draw = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long")))
    rows = scored(spark, d).select("doc_id", "toxic", draw.alias("draw"))
    w = F.pmod(F.col("doc_id") * 31 + F.col("draw") * 7919 + F.col("doc_id") * F.col("draw"), F.lit(3))
    return rows.groupBy("draw").agg(F.round(F.sum(F.col("toxic") * w) / F.sum(w), 9).alias("rate"))


_PLACES = "(SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) a, row_number() OVER (ORDER BY other DESC, doc_id) b, count(*) OVER () n FROM scored)"


@query(f"SELECT doc_id, (1 - (a - 1) / n) * 0.6 + (1 - (b - 1) / n) * 0.4 AS blend FROM {_PLACES}", also=_SCORED)
def rank_average_blend(spark: SparkSession, d: str) -> DataFrame:
    """Two scores blended by their rank shares; both ranks are global and neither needs a single task."""
    rows = scored(spark, d)
    n = rows.agg(F.count("*").alias("n"))
    a = R.ranked(rows, [], "score", "doc_id").select("doc_id", F.col("place").alias("a"))
    b = R.ranked(rows, [], "other", "doc_id").select("doc_id", F.col("place").alias("b"))
    share = lambda c: 1 - (F.col(c) - 1) / F.col("n")
    return a.join(b, "doc_id").join(F.broadcast(n)).select("doc_id", (share("a") * 0.6 + share("b") * 0.4).alias("blend"))


@query("SELECT doc_id, round(score / 1009.0, 9) + 1e-13 * (row_number() OVER (PARTITION BY score ORDER BY doc_id) - 1) AS value FROM scored", also=_SCORED)
def separate_ties(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("__before") - F.col("__low")
    return R.tied(scored(spark, d), [], "score", "doc_id").select("doc_id", (F.round(F.col("score") / 1009.0, 9) + F.lit(1e-13) * k).alias("value"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY score DESC, doc_id) <= round(count(*) OVER () * 0.2) THEN lang ELSE 'none' END AS decision FROM scored", also=_SCORED)
def gate_top_fraction(spark: SparkSession, d: str) -> DataFrame:
    """A decision for the top fifth, none for the rest."""
    rows = scored(spark, d)
    n = rows.agg(F.round(F.count("*") * 0.2).alias("room"))
    placed = R.ranked(rows, [], "score", "doc_id").join(F.broadcast(n))
    return placed.select("doc_id", F.when(F.col("place") <= F.col("room"), F.col("lang")).otherwise("none").alias("decision"))


@query("SELECT doc_id FROM (SELECT doc_id, sum(weight) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) - weight AS mass, sum(weight) OVER () total FROM scored) WHERE mass < 0.1 * total", also=_SCORED)
def weighted_top_mass(spark: SparkSession, d: str) -> DataFrame:
    """The best rows that together reach a tenth of the weight."""
    rows = scored(spark, d)
    total = rows.agg(F.sum("weight").alias("total"))
    r = R.ranked(rows, [], "score", "doc_id", ["weight"]).join(F.broadcast(total))
    return r.where(F.col("cum_weight") - F.col("weight") < 0.1 * F.col("total")).select("doc_id")


@query(
    "SELECT doc_id, CASE WHEN toxic = 1 THEN 0.75 * (0.8 + 0.2 * own) + 0.25 * share ELSE share END AS value FROM (SELECT doc_id, toxic, 1 - (row_number() OVER (ORDER BY score DESC, doc_id) - 1) / count(*) OVER () share, 1 - (row_number() OVER (PARTITION BY toxic ORDER BY score DESC, doc_id) - 1) / count(*) OVER (PARTITION BY toxic) own FROM scored)",
    also=_SCORED,
)
def tail_remap(spark: SparkSession, d: str) -> DataFrame:
    """Candidates moved into the top tail by their rank among candidates; the rest keep their share."""
    rows = scored(spark, d)
    n = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("m"))
    place = R.ranked(rows, [], "score", "doc_id").select("doc_id", "toxic", F.col("place").alias("a"))
    own = R.ranked(rows.where("toxic = 1"), [], "score", "doc_id").select("doc_id", F.col("place").alias("b"))
    share = 1 - (F.col("a") - 1) / F.col("n")
    mine = 1 - (F.col("b") - 1) / F.col("m")
    value = F.when(F.col("toxic") == 1, 0.75 * (0.8 + 0.2 * mine) + 0.25 * share).otherwise(share)
    return place.join(own, "doc_id", "left").join(F.broadcast(n)).select("doc_id", value.alias("value"))


@query(
    "SELECT p1, p2, string_agg(hand_id, ' ' ORDER BY k) evidence FROM (SELECT p1, p2, hand_id, row_number() OVER (PARTITION BY p1, p2 ORDER BY CASE WHEN routed THEN gap ELSE pot END DESC, hand_id) k FROM (SELECT p1, p2, hand_id, abs(net_1 - net_2) gap, contribution_1 + contribution_2 pot, count(*) OVER (PARTITION BY p1, p2) >= 25 routed FROM pairs)) WHERE k <= 5 GROUP BY 1, 2",
    "pairs",
)
def evidence_top5(spark: SparkSession, d: str) -> DataFrame:
    """Five hands for every pair: by one score where the pair is routed to it, by another elsewhere."""
    w = Window.partitionBy("p1", "p2")
    rows = T.pair_hands(spark, d).select("p1", "p2", "hand_id", F.abs(F.col("net_1") - F.col("net_2")).alias("gap"), (F.col("contribution_1") + F.col("contribution_2")).alias("pot"))
    rows = rows.withColumn("score", F.when(F.count("*").over(w) >= 25, F.col("gap")).otherwise(F.col("pot")))
    top = rows.withColumn("k", F.row_number().over(w.orderBy(F.desc("score"), "hand_id"))).where("k <= 5")
    ordered = F.array_sort(F.collect_list(F.struct("k", "hand_id")))
    return top.groupBy("p1", "p2").agg(F.array_join(F.transform(ordered, lambda x: x["hand_id"]), " ").alias("evidence"))
