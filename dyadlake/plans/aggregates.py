"""Aggregations: conditional counts, quantiles, top rows, bins, shares, templates, modes, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadlake.functions import expr as X
from dyadlake.operators import aggregates as A
from dyadlake.operators import ranking as R
from dyadlake.plans.registry import query
from dyadlake.plans.windows import by_pair_time
from dyadlake.sources import tables as T


@query(
    "SELECT player_id, count(*) n, count(*) FILTER (folded = 1) n_folded, count(*) FILTER (showdown = 1 AND net > 0) n_won, CAST(max(folded) AS INT) any_folded, CAST(min(showdown) AS INT) all_shown, avg(folded) folded_rate FROM seats GROUP BY 1", "seats"
)
def cond_counts(spark: SparkSession, d: str) -> DataFrame:
    folded, shown = F.col("folded") == 1, F.col("showdown") == 1
    return T.seats(spark, d).groupBy("player_id").agg(F.count("*").alias("n"), X.count_if(folded).alias("n_folded"), X.count_if(shown & (F.col("net") > 0)).alias("n_won"), F.bool_or(folded).cast("int").alias("any_folded"), F.bool_and(shown).cast("int").alias("all_shown"), X.rate(folded).alias("folded_rate"))


@query(
    "SELECT hand_id, CAST(coalesce(sum(contribution) FILTER (folded = 1), 0) AS BIGINT) folded_sum, max(contribution) FILTER (folded = 0) most_in, min(player_id) FILTER (net > 0) first_winner, arg_max(player_id, contribution * 1000000 - player_id) leader FROM seats GROUP BY 1",
    "seats",
)
def filtered_aggs(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates over part of a group, and the player at the maximum (ties: the smallest)."""
    part = lambda cond, c: F.when(cond, F.col(c))
    return T.seats(spark, d).groupBy("hand_id").agg(X.total(part(F.col("folded") == 1, "contribution")).alias("folded_sum"), F.max(part(F.col("folded") == 0, "contribution")).alias("most_in"), F.min(part(F.col("net") > 0, "player_id")).alias("first_winner"), F.max_by("player_id", F.struct("contribution", -F.col("player_id"))).alias("leader"))


@query(
    "SELECT table_id, phase, quantile_disc(contribution, 0.9) q90, quantile_disc(contribution, 0.99) q99, quantile_cont(contribution, 0.5) middle, round(stddev_samp(contribution), 3) sd FROM seated GROUP BY 1, 2", "seated"
)
def quantile_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles among and between values, and spread."""
    rows = T.seated(spark, d).select("table_id", "phase", "contribution")
    q = R.quantiles(rows, ["table_id", "phase"], "contribution", {"q90": 0.9, "q99": 0.99}, {"middle": 0.5})
    return q.join(rows.groupBy("table_id", "phase").agg(F.round(F.stddev_samp("contribution"), 3).alias("sd")), ["table_id", "phase"])


@query(
    "SELECT p1, p2, sum(pot) FILTER (k <= 3) / count(*) FILTER (k <= 3) top3, CAST(sum(pot) FILTER (k <= 5) AS BIGINT) top5_sum, avg(net_1) FILTER (k <= 5) net_in_top5 FROM (SELECT p1, p2, net_1, contribution_1 + contribution_2 pot, row_number() OVER (PARTITION BY p1, p2 ORDER BY contribution_1 + contribution_2 DESC, hand_id) k FROM pairs) GROUP BY 1, 2",
    "pairs",
)
def topk_mean(spark: SparkSession, d: str) -> DataFrame:
    """Means of the largest three and five hands of a pair, and of another column over them; only five rows a pair leave each group."""
    both = T.pair_hands(spark, d).select("p1", "p2", "hand_id", "net_1", (F.col("contribution_1") + F.col("contribution_2")).alias("pot"))
    top = A.top_rows(both, ["p1", "p2"], [F.desc("pot"), F.asc("hand_id")], 5)
    return top.groupBy("p1", "p2").agg(F.avg(F.when(F.col("place") <= 3, F.col("pot"))).alias("top3"), F.sum("pot").alias("top5_sum"), F.avg("net_1").alias("net_in_top5"))


@query(
    "SELECT player_id, avg(CASE WHEN contribution >= q THEN 1 ELSE 0 END) rate, count(*) FILTER (contribution >= q) n FROM seats, (SELECT quantile_disc(contribution, 0.95) q FROM seats) GROUP BY 1", "seats"
)
def threshold_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often a player is beyond the overall 95 % quantile; that one row is broadcast."""
    own = T.seats(spark, d).select("player_id", "contribution")
    q = R.quantiles(own, [], "contribution", {"q": 0.95})
    beyond = F.col("contribution") >= F.col("q")
    return own.join(F.broadcast(q)).groupBy("player_id").agg(X.rate(beyond).alias("rate"), X.count_if(beyond).alias("n"))


@query(
    "SELECT p1, p2, max(m) most, round(max(m) - avg(m), 6) burst, count(*) bins FROM (SELECT p1, p2, b, avg(lines_1 + lines_2) m FROM (SELECT *, least(7, CAST(floor((row_number() OVER (PARTITION BY p1, p2 ORDER BY started_at, hand_id) - 1) / count(*) OVER (PARTITION BY p1, p2) * 8) AS INT)) b FROM pairs) GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "pairs",
)
def burst_bins(spark: SparkSession, d: str) -> DataFrame:
    """Equal-width chronological bins of each pair: the strongest bin and how far it stands out."""
    position = (F.row_number().over(by_pair_time()) - 1) / F.count("*").over(Window.partitionBy("p1", "p2"))
    rows = T.pair_hands(spark, d).select("p1", "p2", (F.col("lines_1") + F.col("lines_2")).alias("x"), X.equal_width_bin(position, 8).alias("b"))
    return rows.groupBy("p1", "p2", "b").agg(F.avg("x").alias("m")).groupBy("p1", "p2").agg(F.max("m").alias("most"), F.round(F.max("m") - F.avg("m"), 6).alias("burst"), F.count("*").alias("bins"))


@query("SELECT p1, p2, CAST(sum(pot) FILTER (k <= 3) AS BIGINT) / CAST(sum(pot) AS BIGINT) share FROM (SELECT p1, p2, contribution_1 + contribution_2 pot, row_number() OVER (PARTITION BY p1, p2 ORDER BY contribution_1 + contribution_2 DESC, hand_id) k FROM pairs) GROUP BY 1, 2", "pairs")
def concentration_share(spark: SparkSession, d: str) -> DataFrame:
    both = T.pair_hands(spark, d).select("p1", "p2", "hand_id", (F.col("contribution_1") + F.col("contribution_2")).alias("pot"))
    w = Window.partitionBy("p1", "p2").orderBy(F.desc("pot"), "hand_id")
    return both.withColumn("k", F.row_number().over(w)).groupBy("p1", "p2").agg((F.sum(F.when(F.col("k") <= 3, F.col("pot"))) / F.sum("pot")).alias("share"))


@query(
    "SELECT hand_id, street, string_agg(substr(\"action\", 1, 2), ' ' ORDER BY ts, event_id) template, string_agg(substr(\"action\", 1, 2), ' ' ORDER BY ts, event_id) FILTER (k <= 3) opening FROM (SELECT *, row_number() OVER (PARTITION BY hand_id, street ORDER BY ts, event_id) k FROM actions) GROUP BY 1, 2",
    "actions",
)
def ordered_template(spark: SparkSession, d: str) -> DataFrame:
    """A street's actions as an ordered string of tokens, whole and its first three."""
    tokens = A.ordered_tokens(F.substring("action", 1, 2), ["ts", "event_id"])
    one = T.actions(spark, d).groupBy("hand_id", "street").agg(tokens.alias("t"))
    return one.select("hand_id", "street", F.array_join("t", " ").alias("template"), F.array_join(F.slice("t", 1, 3), " ").alias("opening"))


@query("SELECT p1, p2, table_id, n FROM (SELECT p1, p2, table_id, count(*) n, row_number() OVER (PARTITION BY p1, p2 ORDER BY count(*) DESC, table_id) k FROM pairs GROUP BY 1, 2, 3) WHERE k = 1", "pairs")
def mode_per_group(spark: SparkSession, d: str) -> DataFrame:
    """Where each pair meets most; ties go to the smallest table."""
    n = T.pair_hands(spark, d).groupBy("p1", "p2", "table_id").agg(F.count("*").alias("n"))
    return n.groupBy("p1", "p2").agg(F.max_by(F.struct("table_id", "n"), F.struct("n", -F.col("table_id"))).alias("m")).select("p1", "p2", "m.*")


@query("SELECT table_id, phase, count(*) n, count(*) / sum(count(*)) OVER (PARTITION BY table_id) share FROM hands GROUP BY 1, 2", "hands")
def pct_of_total(spark: SparkSession, d: str) -> DataFrame:
    n = T.hands(spark, d).groupBy("table_id", "phase").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("table_id")))


_TOP5 = "top5 AS (SELECT p1, p2, hand_id, k FROM (SELECT p1, p2, hand_id, row_number() OVER (PARTITION BY p1, p2 ORDER BY contribution_1 + contribution_2 DESC, hand_id) k FROM pairs) WHERE k <= 5)"


def top5(spark: SparkSession, d: str) -> DataFrame:
    both = T.pair_hands(spark, d).select("p1", "p2", "hand_id", (F.col("contribution_1") + F.col("contribution_2")).alias("pot"))
    return A.top_rows(both, ["p1", "p2"], [F.desc("pot"), F.asc("hand_id")], 5)


@query("SELECT p1, p2, " + ", ".join(f"max(hand_id) FILTER (k = {k}) AS hand_{k}" for k in range(1, 6)) + " FROM top5 GROUP BY 1, 2", "pairs", also=_TOP5)
def pivot_top5(spark: SparkSession, d: str) -> DataFrame:
    """One row a pair, its evidence in five columns."""
    wide = top5(spark, d).groupBy("p1", "p2").pivot("place", [1, 2, 3, 4, 5]).agg(F.max("hand_id"))
    return wide.toDF("p1", "p2", *[f"hand_{k}" for k in range(1, 6)])


@query("SELECT p1, p2, 'hand_' || k AS place, hand_id FROM top5", "pairs", also=_TOP5)
def unpivot_evidence(spark: SparkSession, d: str) -> DataFrame:
    return pivot_top5(spark, d).unpivot(["p1", "p2"], [f"hand_{k}" for k in range(1, 6)], "place", "hand_id").where("hand_id is not null")


@query(
    "SELECT player_id, count(DISTINCT part) n_parts, count(DISTINCT CASE WHEN folded = 1 THEN part END) n_folded_parts, count(DISTINCT table_id) n_tables FROM seated GROUP BY 1", "seated"
)
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.seated(spark, d).groupBy("player_id").agg(F.countDistinct("part").alias("n_parts"), F.countDistinct(F.when(F.col("folded") == 1, F.col("part"))).alias("n_folded_parts"), F.countDistinct("table_id").alias("n_tables"))


@query("SELECT event_type, street, count(*) n, median(amount) middle, min(amount) least, max(amount) most, quantile_cont(amount, 0.25) q25, quantile_cont(amount, 0.75) q75 FROM (SELECT *, \"action\" event_type FROM actions) GROUP BY 1, 2", "actions")
def profile_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts and quantiles of a column by two dimensions."""
    rows = T.actions(spark, d).select(F.col("action").alias("event_type"), "street", "amount")
    q = R.quantiles(rows, ["event_type", "street"], "amount", cont={"middle": 0.5, "q25": 0.25, "q75": 0.75})
    return q.join(rows.groupBy("event_type", "street").agg(F.count("*").alias("n"), F.min("amount").alias("least"), F.max("amount").alias("most")), ["event_type", "street"])


@query(
    "SELECT p1, p2, count(*) shared, count(*) / (n1 + n2 - count(*)) jaccard, round(count(*) / sqrt(n1 * n2), 6) cosine, count(*) / least(n1, n2) overlap FROM pairs JOIN (SELECT player_id p1, count(*) n1 FROM seats GROUP BY 1) USING (p1) JOIN (SELECT player_id p2, count(*) n2 FROM seats GROUP BY 1) USING (p2) GROUP BY p1, p2, n1, n2",
    "pairs",
)
def co_presence(spark: SparkSession, d: str) -> DataFrame:
    """Shared hands against what each plays: Jaccard, cosine and overlap."""
    own = T.seats(spark, d).groupBy("player_id").agg(F.count("*").alias("n"))
    shared = T.pair_hands(spark, d).groupBy("p1", "p2").agg(F.count("*").alias("shared"))
    for k in "12":
        shared = shared.join(own.select(F.col("player_id").alias(f"p{k}"), F.col("n").alias(f"n{k}")), f"p{k}")
    return shared.select("p1", "p2", "shared", (F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).alias("jaccard"), F.round(F.col("shared") / F.sqrt(F.col("n1") * F.col("n2")), 6).alias("cosine"), (F.col("shared") / F.least("n1", "n2")).alias("overlap"))


@query(
    "SELECT p1, p2, CASE WHEN a.s_nationkey = b.s_nationkey THEN 1 ELSE 0 END same_nation, CASE WHEN m.n_regionkey = n.n_regionkey THEN 1 ELSE 0 END same_region, round(abs(a.s_acctbal - b.s_acctbal), 2) balance_gap FROM (SELECT DISTINCT p1, p2 FROM pairs) JOIN supplier a ON a.s_suppkey = p1 JOIN supplier b ON b.s_suppkey = p2 JOIN nation m ON m.n_nationkey = a.s_nationkey JOIN nation n ON n.n_nationkey = b.s_nationkey",
    "pairs",
)
def pair_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What both members of a pair have in common."""
    nations = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    who = T.table(spark, d, "supplier").join(nations, "s_nationkey")
    both = T.pair_hands(spark, d).select("p1", "p2").distinct()
    for k in "12":
        both = both.join(who.select(F.col("s_suppkey").alias(f"p{k}"), F.col("s_nationkey").alias(f"nation{k}"), F.col("region").alias(f"region{k}"), F.col("s_acctbal").alias(f"balance{k}")), f"p{k}")
    same = lambda c: (F.col(f"{c}1") == F.col(f"{c}2")).cast("int")
    return both.select("p1", "p2", same("nation").alias("same_nation"), same("region").alias("same_region"), F.round(F.abs(F.col("balance1") - F.col("balance2")), 2).alias("balance_gap"))
