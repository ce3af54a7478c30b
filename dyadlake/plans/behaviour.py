"""Smoothed rates, surprise, contrasts, coincidence, and the pair-hand and pair fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadlake.functions import expr as X
from dyadlake.operators import aggregates as A
from dyadlake.operators import behaviour as B
from dyadlake.operators import pairs as P
from dyadlake.plans.registry import query
from dyadlake.plans.windows import hand_index
from dyadlake.sources import tables as T


@query(
    """SELECT *, CAST(percent_rank() OVER (PARTITION BY table_id ORDER BY moved) AS DOUBLE) moved_rank, percent_rank() OVER (PARTITION BY table_id ORDER BY n) n_rank FROM (
 SELECT table_id, p1, p2, count(*) n, CAST(sum(least(greatest(-net_1, 0), greatest(net_2, 0))) AS BIGINT) moved_12, CAST(sum(least(greatest(-net_2, 0), greatest(net_1, 0))) AS BIGINT) moved_21,
 CAST(sum(least(greatest(-net_1, 0), greatest(net_2, 0)) + least(greatest(-net_2, 0), greatest(net_1, 0))) AS BIGINT) moved, CAST(abs(sum(least(greatest(-net_1, 0), greatest(net_2, 0)) - least(greatest(-net_2, 0), greatest(net_1, 0)))) AS BIGINT) / nullif(CAST(sum(least(greatest(-net_1, 0), greatest(net_2, 0)) + least(greatest(-net_2, 0), greatest(net_1, 0))) AS BIGINT), 0) one_way,
 avg(folded_1 * folded_2) both_folded FROM pairs GROUP BY 1, 2, 3)""",
    "pairs",
)
def pool_pair_features(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: what each pair of each table moved between its members, how one-sidedly, and its rank in the table."""
    seats = T.seats(spark, d, by_hand=True)
    return B.pool_features(P.in_one_pass(seats, "hand_id", "player_id", ["net", "folded"]).join(T.hands(spark, d), "hand_id"))


_POLICY = "policy AS (SELECT table_id, lines, sum(folded) s, count(*) n FROM seated GROUP BY 1, 2), prior AS (SELECT lines, sum(folded) / count(*) p FROM seated GROUP BY 1)"


@query("SELECT table_id, lines, n, (s + 20 * p) / (n + 20) AS rate FROM policy JOIN prior USING (lines)", "seated", also=_POLICY)
def policy_table(spark: SparkSession, d: str) -> DataFrame:
    """Fold rates by table and number of lines, smoothed towards the overall rate (20 rows' weight)."""
    return B.policy(T.seated(spark, d), ["table_id"], ["lines"], "folded", 20.0)


@query(
    "SELECT player_id, count(*) n, round(sum(-ln(least(greatest(CASE WHEN folded = 1 THEN rate ELSE 1 - rate END, 1e-5), 1.0))), 4) surprise FROM seated JOIN (SELECT table_id, lines, (s + 20 * p) / (n + 20) AS rate FROM policy JOIN prior USING (lines)) USING (table_id, lines) GROUP BY 1",
    "seated", also=_POLICY,
)
def surprise_sum(spark: SparkSession, d: str) -> DataFrame:
    """How improbable a player's choices are under the table's policy."""
    own = T.seated(spark, d).select("player_id", "table_id", "lines", "folded")
    rates = policy_table(spark, d).drop("n")
    taken = F.when(F.col("folded") == 1, F.col("rate")).otherwise(1 - F.col("rate"))
    return own.join(rates, ["table_id", "lines"]).groupBy("player_id").agg(F.count("*").alias("n"), F.round(F.sum(X.surprise(taken)), 4).alias("surprise"))


@query("SELECT player_id, (count(*) FILTER (folded = 1) + 5 * 0.3) / (count(*) + 5) fold_rate, (count(*) FILTER (showdown = 1 AND net > 0) + 5 * 0.25) / (count(*) FILTER (showdown = 1) + 5) win_rate FROM seats GROUP BY 1", "seats")
def player_rates_smoothed(spark: SparkSession, d: str) -> DataFrame:
    shown = F.col("showdown") == 1
    n = lambda c: X.count_if(c)
    return T.seats(spark, d).groupBy("player_id").agg(X.smoothed(n(F.col("folded") == 1), F.count("*"), 0.3, 5).alias("fold_rate"), X.smoothed(n(shown & (F.col("net") > 0)), n(shown), 0.25, 5).alias("win_rate"))


@query(
    """SELECT hand_id, player_id, fold, round((coalesce(ks, 0) - fs + 10 * (ts - tfs) / (tn - tfn)) / (coalesce(kn, 0) - fn + 10), 9) AS encoded FROM (
 SELECT *, sum(folded) OVER (PARTITION BY part) ks, count(*) OVER (PARTITION BY part) kn, sum(folded) OVER (PARTITION BY part, fold) fs, count(*) OVER (PARTITION BY part, fold) fn, sum(folded) OVER (PARTITION BY fold) tfs, count(*) OVER (PARTITION BY fold) tfn, sum(folded) OVER () ts, count(*) OVER () tn FROM (SELECT hand_id, player_id, part % 50 AS part, folded, ((hand_id * 7919 + 3) % 10007) % 5 AS fold FROM seats))""",
    "seats",
)
def target_encode_oof(spark: SparkSession, d: str) -> DataFrame:
    """A category's mean label over the other folds, smoothed by ten rows of the prior."""
    rows = T.seats(spark, d).select("hand_id", "player_id", (F.col("part") % 50).alias("part"), "folded", X.fold_of("hand_id", 5, 3).alias("fold"))
    return A.out_of_fold_rate(rows, ["part"], "fold", "folded", 10.0).select("hand_id", "player_id", "fold", F.round("encoded", 9).alias("encoded"))


@query(
    "SELECT p1 AS member, p2 AS partner, n, s / n AS mean_with, (ts - s) / nullif(tn - n, 0) mean_without, (s / n - coalesce((ts - s) / nullif(tn - n, 0), s / n)) * n / (n + 25.0) shrunk FROM (SELECT p1, p2, count(*) n, CAST(sum(folded_1) AS BIGINT) s FROM (SELECT p1, p2, folded_1 FROM pairs UNION ALL SELECT p2, p1, folded_2 FROM pairs) GROUP BY 1, 2) JOIN (SELECT player_id p1, count(*) tn, CAST(sum(folded) AS BIGINT) ts FROM seats GROUP BY 1) USING (p1)",
    "pairs",
)
def shrunk_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Each member's fold rate with one partner against that without, the latter by subtracting from the totals: two rows a pair."""
    seats = T.seats(spark, d)
    own = seats.groupBy(F.col("player_id").alias("member")).agg(F.sum("folded").alias("total"), F.count("*").alias("n"))
    sides = F.explode(F.array(*[F.struct(F.col(f"p{a}").alias("member"), F.col(f"p{b}").alias("partner"), F.col(f"folded_{a}").alias("folded")) for a, b in ((1, 2), (2, 1))]))
    shared = T.pair_hands(spark, d).select(sides.alias("s")).groupBy("s.member", "s.partner").agg(F.sum("s.folded").alias("total"), F.count("*").alias("n"))
    both = P.without_partner(own, shared, "member", "total", "n")
    return both.withColumn("shrunk", X.shrunk(F.col("mean_with"), F.coalesce("mean_without", "mean_with"), "n", 25.0))


@query(
    "SELECT p1, p2, phase, n, m, coalesce((m - other_m) * n / (n + 30.0), 0.0) AS contrast FROM (SELECT p1, p2, phase, count(*) n, avg(lines_1) m FROM pairs GROUP BY 1, 2, 3) a LEFT JOIN (SELECT p1, p2, CASE phase WHEN 'development' THEN 'evaluation' ELSE 'development' END phase, avg(lines_1) other_m FROM pairs GROUP BY 1, 2, 3) b USING (p1, p2, phase)",
    "pairs",
)
def other_phase_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Each pair and phase against the pair's other phase, shrunk by its number of hands."""
    one = T.pair_hands(spark, d).groupBy("p1", "p2", "phase").agg(F.count("*").alias("n"), F.avg("lines_1").alias("m"))
    swapped = F.when(F.col("phase") == "development", "evaluation").otherwise("development")
    other = one.select("p1", "p2", swapped.alias("phase"), F.col("m").alias("other"))
    return one.join(other, ["p1", "p2", "phase"], "left").select("p1", "p2", "phase", "n", "m", F.coalesce(X.shrunk(F.col("m"), F.col("other"), "n", 30.0), F.lit(0.0)).alias("contrast"))


@query(
    "SELECT p1, p2, n, observed, round(n * q1 * q2, 6) expected, round((observed - n * q1 * q2) / sqrt(n * q1 * q2 + 0.5), 6) + 0.0 z, round((observed + 0.5) / (n * q1 * q2 + 0.5), 6) ratio FROM (SELECT p1, p2, count(*) n, CAST(sum(folded_1 * folded_2) AS BIGINT) observed FROM pairs GROUP BY 1, 2) JOIN (SELECT player_id p1, avg(folded) q1 FROM seats GROUP BY 1) USING (p1) JOIN (SELECT player_id p2, avg(folded) q2 FROM seats GROUP BY 1) USING (p2)",
    "pairs",
)
def coincidence_z(spark: SparkSession, d: str) -> DataFrame:
    """Hands in which both fold, against independence."""
    rates = T.seats(spark, d).groupBy("player_id").agg(F.avg("folded").alias("q"))
    one = T.pair_hands(spark, d).groupBy("p1", "p2").agg(F.count("*").alias("n"), F.sum(F.col("folded_1") * F.col("folded_2")).alias("observed"))
    for k in "12":
        one = one.join(rates.select(F.col("player_id").alias(f"p{k}"), F.col("q").alias(f"q{k}")), f"p{k}")
    c = X.coincidence("observed", "n", "q1", "q2")
    return one.select("p1", "p2", "n", "observed", *[X.rounded(c[k]).alias(k) for k in ("expected", "z", "ratio")])


@query(
    "SELECT p1, p2, (d1 + d2) / 2 AS mean_delta, least(d1, d2) least_delta, greatest(d1, d2) most_delta, greatest(abs(d1), abs(d2)) abs_delta, abs(d1 - d2) gap FROM (SELECT p1, p2, avg(lines_1) - b1 AS d1, avg(lines_2) - b2 AS d2 FROM pairs JOIN (SELECT player_id p1, avg(lines) b1 FROM seats GROUP BY 1) USING (p1) JOIN (SELECT player_id p2, avg(lines) b2 FROM seats GROUP BY 1) USING (p2) GROUP BY p1, p2, b1, b2)",
    "pairs",
)
def member_delta_sym(spark: SparkSession, d: str) -> DataFrame:
    """Both members' deviation from their own baseline, independent of which is first."""
    own = T.seats(spark, d).groupBy("player_id").agg(F.avg("lines").alias("b"))
    one = T.pair_hands(spark, d).groupBy("p1", "p2").agg(F.avg("lines_1").alias("m1"), F.avg("lines_2").alias("m2"))
    for k in "12":
        one = one.join(own.select(F.col("player_id").alias(f"p{k}"), F.col("b").alias(f"b{k}")), f"p{k}")
    return one.select("p1", "p2", *B.symmetric(F.col("m1") - F.col("b1"), F.col("m2") - F.col("b2")))


@query(
    "SELECT p1, p2, w AS window_no, count(*) n, CAST(sum(lines_1 + lines_2) AS BIGINT) lines FROM (SELECT p1, p2, lines_1, lines_2, i FROM pairs JOIN (SELECT hand_id, row_number() OVER (PARTITION BY table_id ORDER BY started_at, hand_id) - 1 i FROM hands) USING (hand_id)) JOIN (VALUES (0, 0, 2000), (1, 1000, 3000)) v(w, lo, hi) ON i >= lo AND i < hi GROUP BY 1, 2, 3",
    "pairs",
)
def exposure_windows(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping windows of hand positions: each hand is exploded into those it lies in."""
    index = hand_index(spark, d).select("hand_id", F.col("hand_index").alias("i"))
    rows = T.pair_hands(spark, d).select("p1", "p2", "hand_id", "lines_1", "lines_2").join(index, "hand_id")
    bounds = ((0, 0, 2000), (1, 1000, 3000))
    inside = F.filter(F.array(*[F.when((F.col("i") >= lo) & (F.col("i") < hi), k) for k, lo, hi in bounds]), lambda x: x.isNotNull())
    return rows.withColumn("window_no", F.explode(inside)).groupBy("p1", "p2", "window_no").agg(F.count("*").alias("n"), F.sum(F.col("lines_1") + F.col("lines_2")).alias("lines"))


@query(
    "SELECT d.doc_id, CASE WHEN toxic = 1 THEN 5.0 WHEN toxic = 0 THEN 1.0 ELSE 0.1 * n / k END AS weight FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id, (SELECT count(*) n FROM documents), (SELECT count(*) k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"
)
def pu_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of labelled and unlabelled rows; the unlabelled stand for the whole population."""
    docs, labels = T.table(spark, d, "documents").select("doc_id"), T.table(spark, d, "labels")
    counts = docs.agg(F.count("*").alias("n")).join(F.broadcast(docs.join(labels, "doc_id", "left_anti").agg(F.count("*").alias("k"))))
    w = F.when(F.col("toxic") == 1, 5.0).when(F.col("toxic") == 0, 1.0).otherwise(F.lit(0.1) * F.col("n") / F.nullif("k", F.lit(0)))
    return docs.join(labels, "doc_id", "left").join(F.broadcast(counts)).select("doc_id", w.alias("weight"))


@query(
    "SELECT member, partner, phase, n, won, won / n AS with_rate, (tw - won) / nullif(tn - n, 0) field_rate FROM (SELECT member, partner, phase, count(*) n, count(*) FILTER (net > 0) won FROM (SELECT hand_id, p1 member, p2 partner, phase, net_1 net FROM pairs UNION ALL SELECT hand_id, p2, p1, phase, net_2 FROM pairs) GROUP BY 1, 2, 3) JOIN (SELECT player_id member, phase, count(*) tn, count(*) FILTER (net > 0) tw FROM seated GROUP BY 1, 2) USING (member, phase)",
    "pairs", "seated",
)
def with_without_partner(spark: SparkSession, d: str) -> DataFrame:
    """How often a member wins with a partner in the hand, and in all other hands of the phase."""
    totals = T.seated(spark, d).groupBy(F.col("player_id").alias("member"), "phase").agg(F.count("*").alias("tn"), X.count_if(F.col("net") > 0).alias("tw"))
    both = T.pair_hands(spark, d).select("phase", F.explode(F.array(F.struct(F.col("p1").alias("member"), F.col("p2").alias("partner"), F.col("net_1").alias("net")), F.struct(F.col("p2").alias("member"), F.col("p1").alias("partner"), F.col("net_2").alias("net")))).alias("m")).select("phase", "m.*")
    one = both.groupBy("member", "partner", "phase").agg(F.count("*").alias("n"), X.count_if(F.col("net") > 0).alias("won"))
    return one.join(totals, ["member", "phase"]).select("member", "partner", "phase", "n", "won", (F.col("won") / F.col("n")).alias("with_rate"), X.ratio(F.col("tw") - F.col("won"), F.col("tn") - F.col("n")).alias("field_rate"))


@query(
    """SELECT p1, p2, hand_id, net_1 - net_2 signed_gap, abs(net_1 - net_2) net_gap, least(greatest(-net_1, 0), greatest(net_2, 0)) moved_12, least(greatest(-net_2, 0), greatest(net_1, 0)) moved_21, CASE WHEN net_1 < net_2 THEN 1 ELSE 0 END loser_is_first,
 CASE WHEN folded_1 = 0 AND folded_2 = 0 THEN 1 ELSE 0 END both_stayed, CASE WHEN folded_1 <> folded_2 THEN 1 ELSE 0 END one_folded, CASE WHEN showdown_1 = 1 AND showdown_2 = 1 THEN 1 ELSE 0 END both_shown, lines_1 + lines_2 AS lines, (contribution_1 + contribution_2) / (max(contribution_1 + contribution_2) OVER (PARTITION BY p1, p2) + 1e-6) pot_to_max,
 CASE WHEN net_1 < net_2 AND folded_1 = 1 OR net_1 >= net_2 AND folded_2 = 1 THEN 1 ELSE 0 END loser_folded FROM pairs""",
    "pairs",
)
def pair_hand_features(spark: SparkSession, d: str) -> DataFrame:
    """The pair-hand fact table: one declarative list of columns."""
    return B.pair_hand_features(T.pair_hands(spark, d))


@query(
    """SELECT p1, p2, count(*) n, avg(both_stayed) both_stayed_mean, avg(one_folded) one_folded_mean, max(net_gap) net_gap_max, CAST(sum(moved_12) AS BIGINT) moved_12_sum, CAST(sum(moved_21) AS BIGINT) moved_21_sum, CAST(abs(sum(moved_12 - moved_21)) AS BIGINT) / nullif(CAST(sum(moved_12 + moved_21) AS BIGINT), 0) imbalance, avg(loser_is_first) direction FROM (
 SELECT p1, p2, abs(net_1 - net_2) net_gap, least(greatest(-net_1, 0), greatest(net_2, 0)) moved_12, least(greatest(-net_2, 0), greatest(net_1, 0)) moved_21, CASE WHEN net_1 < net_2 THEN 1 ELSE 0 END loser_is_first, CASE WHEN folded_1 = 0 AND folded_2 = 0 THEN 1 ELSE 0 END both_stayed, CASE WHEN folded_1 <> folded_2 THEN 1 ELSE 0 END one_folded FROM pairs) GROUP BY 1, 2""",
    "pairs",
)
def pair_features(spark: SparkSession, d: str) -> DataFrame:
    """The pair fact table: means, maxima and sums of the pair-hand columns, and what follows from them."""
    return B.pair_features(B.pair_hand_features(T.pair_hands(spark, d)))


@query(
    """SELECT p1, p2, hand_id, k, pot / (max(pot) OVER (PARTITION BY p1, p2) + 1e-6) to_max, pot / CAST(sum(pot) OVER (PARTITION BY p1, p2) AS BIGINT) share, coalesce(i - lag(i) OVER (PARTITION BY p1, p2, table_id ORDER BY i), 9999) gap_before, count(*) OVER (PARTITION BY p1, p2, table_id ORDER BY i RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) near FROM (
 SELECT p1, p2, hand_id, pot, i, k, table_id FROM (SELECT p1, p2, hand_id, contribution_1 + contribution_2 pot, row_number() OVER (PARTITION BY p1, p2 ORDER BY contribution_1 + contribution_2 DESC, hand_id) k FROM pairs) JOIN (SELECT hand_id, table_id, row_number() OVER (PARTITION BY table_id ORDER BY started_at, hand_id) - 1 i FROM hands) USING (hand_id) WHERE k <= 20)""",
    "pairs",
)
def pair_pool_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best hands of each pair with features relative to that pool."""
    index = hand_index(spark, d).select("hand_id", "table_id", F.col("hand_index").alias("i"))
    both = T.pair_hands(spark, d).select("p1", "p2", "hand_id", (F.col("contribution_1") + F.col("contribution_2")).alias("pot"))
    pool = A.top_rows(both, ["p1", "p2"], [F.desc("pot"), F.asc("hand_id")], 20).join(index, "hand_id")
    w = Window.partitionBy("p1", "p2")
    by_place = Window.partitionBy("p1", "p2", "table_id").orderBy("i")
    return pool.select("p1", "p2", "hand_id", F.col("place").cast("long").alias("k"), X.ratio_to_max("pot", ["p1", "p2"]).alias("to_max"), (F.col("pot") / F.sum("pot").over(w)).alias("share"), F.coalesce(F.col("i") - F.lag("i").over(by_place), F.lit(9999)).cast("long").alias("gap_before"), F.count("*").over(by_place.rangeBetween(-20, 20)).alias("near"))
