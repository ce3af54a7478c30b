"""Folds, samples, validators, curves and threshold rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadlake.functions import expr as X
from dyadlake.operators import cards as K
from dyadlake.operators import ranking as R
from dyadlake.plans import cards as deals
from dyadlake.plans.ranking import _SCORED, scored
from dyadlake.plans.registry import query
from dyadlake.sources import tables as T


@query(
    "SELECT coalesce(a.player_id, b.player_id, c.player_id) player_id, coalesce(a.n, 0) na, coalesce(b.n, 0) nb, coalesce(c.n, 0) nc FROM (SELECT player_id, count(*) n FROM seats WHERE lines = 1 GROUP BY 1) a FULL JOIN (SELECT player_id, count(*) n FROM seats WHERE lines = 2 GROUP BY 1) b ON a.player_id = b.player_id FULL JOIN (SELECT player_id, count(*) n FROM seats WHERE lines >= 3 GROUP BY 1) c ON c.player_id = coalesce(a.player_id, b.player_id)",
    "seats",
)
def three_way_full(spark: SparkSession, d: str) -> DataFrame:
    """Three frames joined in full on one coalesced key."""
    seats = T.seats(spark, d)
    part = lambda cond, name: seats.where(cond).groupBy("player_id").agg(F.count("*").alias(name))
    return part("lines = 1", "na").join(part("lines = 2", "nb"), "player_id", "full").join(part("lines >= 3", "nc"), "player_id", "full").fillna(0)


@query("SELECT doc_id, lang, toxic, (row_number() OVER (PARTITION BY lang, toxic ORDER BY (doc_id * 7919 + 3) % 10007, doc_id) - 1) % 5 fold FROM scored", also=_SCORED)
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    """Folds of equal size in every stratum, in a seeded order; strata of any size."""
    rows = scored(spark, d).select("doc_id", "lang", "toxic", (-F.pmod(F.col("doc_id") * 7919 + 3, F.lit(10007))).alias("o"))
    return R.ranked(rows, ["lang", "toxic"], "o", "doc_id").select("doc_id", "lang", "toxic", ((F.col("place") - 1) % 5).alias("fold"))


@query("SELECT event_id, user_id FROM events WHERE (event_id * 7919 + 11) % 10007 < 2502")
def seeded_fraction_sample(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the rows by a seeded hash: a sampling operator that no partitioning changes."""
    return T.table(spark, d, "events").where(F.pmod(F.col("event_id") * 7919 + 11, F.lit(10007)) < 2502).select("event_id", "user_id")


@query(
    "SELECT p1, p2, m, n * (m - g) / (n + 30.0) AS diff, (m + 0.05) / (g + 0.05) AS ratio FROM (SELECT p1, p2, count(*) n, avg(lines_1 + lines_2) m FROM pairs GROUP BY 1, 2), (SELECT quantile_cont(m, 0.5) g FROM (SELECT avg(lines_1 + lines_2) m FROM pairs GROUP BY p1, p2))",
    "pairs",
)
def shrunk_to_median(spark: SparkSession, d: str) -> DataFrame:
    """A pair's mean against the median pair's, shrunk by its hands."""
    one = T.pair_hands(spark, d).groupBy("p1", "p2").agg(F.count("*").alias("n"), F.avg(F.col("lines_1") + F.col("lines_2")).alias("m"))
    g = R.quantiles(one, [], "m", cont={"g": 0.5})
    return one.join(F.broadcast(g)).select("p1", "p2", "m", (F.col("n") * (F.col("m") - F.col("g")) / (F.col("n") + 30.0)).alias("diff"), ((F.col("m") + 0.05) / (F.col("g") + 0.05)).alias("ratio"))


@query(
    "SELECT hand_id, player_id, least(greatest(contribution / greatest(total - contribution, 1), 0.0), 20.0) pot_ratio, contribution / total AS share, least(contribution / (quantity * 100000.0), 100.0) depth FROM (SELECT *, CAST(sum(contribution) OVER (PARTITION BY hand_id) AS BIGINT) total FROM seats)",
    "seats",
)
def action_ratios(spark: SparkSession, d: str) -> DataFrame:
    """A seat's contribution against the rest, the whole and its own depth, clipped."""
    total = F.sum("contribution").over(Window.partitionBy("hand_id"))
    rows = T.seats(spark, d).withColumn("total", total)
    return rows.select("hand_id", "player_id", X.clip(F.col("contribution") / X.clip(F.col("total") - F.col("contribution"), 1), 0.0, 20.0).alias("pot_ratio"), (F.col("contribution") / F.col("total")).alias("share"), X.clip(F.col("contribution") / (F.col("quantity") * 100000.0), None, 100.0).alias("depth"))


@query("SELECT p_partkey, CAST(greatest(a // 4, b // 4) + 2 + CASE WHEN a // 4 = b // 4 THEN 7.0 ELSE 0.0 END + CASE WHEN a % 4 = b % 4 THEN 1.5 ELSE 0.0 END AS DOUBLE) AS strength FROM hole", also=deals._HOLE)
def hole_strength(spark: SparkSession, d: str) -> DataFrame:
    """A plain strength of two cards: the higher rank, 7 for a pair, 1.5 for one suit."""
    a, b = F.col("a"), F.col("b")
    pair, suited = F.when(K.rank(a) == K.rank(b), 7.0).otherwise(0.0), F.when(K.suit(a) == K.suit(b), 1.5).otherwise(0.0)
    return deals.hole(spark, d).select("p_partkey", (F.greatest(K.rank(a), K.rank(b)) + 2 + pair + suited).alias("strength"))


@query(
    f"SELECT hand_id, player_id, v, rank() OVER (PARTITION BY hand_id ORDER BY v DESC) place, v - max(v) OVER (PARTITION BY hand_id) AS behind FROM seats JOIN ({deals._RIVER[0]}) ON p_partkey = part",
    "seats", also=deals._RIVER[1],
)
def strength_in_hand(spark: SparkSession, d: str) -> DataFrame:
    """Each seat's exact card value and its rank among the hand's seats; the value is computed once for each part."""
    values = deals.values(spark, d, v=7).withColumnRenamed("p_partkey", "part")
    w = Window.partitionBy("hand_id")
    return T.seats(spark, d).select("hand_id", "player_id", "part").join(values, "part").select("hand_id", "player_id", "v", F.rank().over(w.orderBy(F.desc("v"))).cast("long").alias("place"), (F.col("v") - F.max("v").over(w)).alias("behind"))


@query(
    "SELECT score, max(place) predicted, CAST(max(hits) AS BIGINT) hits, max(hits) / max(place) AS precision, max(hits) / (SELECT sum(toxic) FROM scored) recall FROM (SELECT score, row_number() OVER (ORDER BY score DESC, doc_id) place, CAST(sum(toxic) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) hits FROM scored) GROUP BY 1", also=_SCORED
)
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    """The precision-recall curve, a point for each score."""
    rows = scored(spark, d)
    r = R.ranked(rows, [], "score", "doc_id", ["toxic"]).groupBy("score").agg(F.max("place").alias("predicted"), F.max("cum_toxic").alias("hits"))
    total = rows.agg(F.sum("toxic").alias("t"))
    return r.join(F.broadcast(total)).select("score", "predicted", "hits", (F.col("hits") / F.col("predicted")).alias("precision"), (F.col("hits") / F.col("t")).alias("recall"))


@query(
    "SELECT r AS rate, n AS chosen, hits, round(2.0 * hits / (n + total), 9) f1, CASE WHEN round(2.0 * hits / (n + total), 9) >= max(round(2.0 * hits / (n + total), 9)) OVER () - 0.005 AND r = min(CASE WHEN ok THEN r END) OVER () THEN 1 ELSE 0 END AS picked FROM (SELECT *, round(2.0 * hits / (n + total), 9) >= max(round(2.0 * hits / (n + total), 9)) OVER () - 0.005 AS ok FROM (SELECT r, count(*) FILTER (place <= round(k * r)) n, CAST(sum(toxic) FILTER (place <= round(k * r)) AS BIGINT) hits, CAST(sum(toxic) AS BIGINT) total FROM (SELECT toxic, row_number() OVER (ORDER BY score DESC, doc_id) place, count(*) OVER () k FROM scored), (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.3), (0.5)) v(r) GROUP BY r))",
    also=_SCORED,
)
def activation_rate(spark: SparkSession, d: str) -> DataFrame:
    """The smallest rate of a grid whose F1 is within 0.005 of the best."""
    rows = scored(spark, d)
    n = rows.agg(F.count("*").alias("k"))
    placed = R.ranked(rows, [], "score", "doc_id").join(F.broadcast(n)).withColumn("rate", F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.2, 0.3, 0.5)))))
    inside = F.col("place") <= F.round(F.col("k") * F.col("rate"))
    grid = placed.groupBy("rate").agg(X.count_if(inside).alias("chosen"), F.sum(F.when(inside, F.col("toxic"))).alias("hits"), F.sum("toxic").alias("total"))
    grid = grid.withColumn("f1", F.round(F.lit(2.0) * F.col("hits") / (F.col("chosen") + F.col("total")), 9)).drop("total")
    best = grid.agg(F.max("f1").alias("best"))
    good = grid.join(F.broadcast(best)).withColumn("ok", F.col("f1") >= F.col("best") - 0.005)
    first = good.where("ok").agg(F.min("rate").alias("first"))
    return good.join(F.broadcast(first)).select("rate", "chosen", "hits", "f1", (F.col("rate") == F.col("first")).cast("int").alias("picked"))


@query(
    "SELECT 'repeated' AS fault, count(*) n FROM (SELECT p1, p2, hand_id FROM evidence GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'too_many', count(*) FROM (SELECT p1, p2 FROM evidence GROUP BY ALL HAVING count(*) > 5) UNION ALL SELECT 'not_shared', count(*) FROM evidence e WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.p1 = e.p1 AND p.p2 = e.p2 AND p.hand_id = e.hand_id)",
    "pairs",
    also="evidence AS (SELECT p1, p2, hand_id FROM (SELECT p1, p2, hand_id, row_number() OVER (PARTITION BY p1, p2 ORDER BY contribution_1 + contribution_2 DESC, hand_id) k FROM pairs) WHERE k <= 5 UNION ALL SELECT -1, -2, 0)",
)
def evidence_validator(spark: SparkSession, d: str) -> DataFrame:
    """Counts of faults in an evidence table: repeats, more than five, hands that the pair doesn't share (one is planted)."""
    from dyadlake.plans.aggregates import top5

    planted = spark.range(1).select(F.lit(-1).cast("long").alias("p1"), F.lit(-2).cast("long").alias("p2"), F.lit(0).cast("long").alias("hand_id"))
    evidence = top5(spark, d).select("p1", "p2", "hand_id").unionByName(planted)
    fault = lambda name, df: df.agg(F.lit(name).alias("fault"), F.count("*").alias("n"))
    repeated = evidence.groupBy("p1", "p2", "hand_id").count().where("count > 1")
    many = evidence.groupBy("p1", "p2").count().where("count > 5")
    stray = evidence.join(T.pair_hands(spark, d).select("p1", "p2", "hand_id"), ["p1", "p2", "hand_id"], "left_anti")
    return fault("repeated", repeated).union(fault("too_many", many)).union(fault("not_shared", stray))
