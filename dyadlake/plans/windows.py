"""Window functions over ordered episodes: positions, running values, ranks, gaps, rolling sums, top rows and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from dyadlake.functions import expr as X
from dyadlake.operators import aggregates as A
from dyadlake.operators import ranking as R
from dyadlake.plans.registry import query
from dyadlake.sources import tables as T


def by_pair_time() -> WindowSpec:
    return Window.partitionBy("p1", "p2").orderBy("started_at", "hand_id")


_PAIR_TIME = "OVER (PARTITION BY p1, p2 ORDER BY started_at, hand_id"


@query("SELECT hand_id, table_id, row_number() OVER (PARTITION BY table_id ORDER BY started_at, hand_id) - 1 hand_index FROM hands", "hands")
def hand_index(spark: SparkSession, d: str) -> DataFrame:
    """Each hand's position in its table; a table's hands are dealt out by ranges of time, since few tables may hold them all."""
    return R.positions(T.hands(spark, d), ["table_id"], "started_at", "hand_id", "hand_index").select("hand_id", "table_id", "hand_index")


def by_street() -> WindowSpec:
    return Window.partitionBy("hand_id", "street").orderBy("ts", "event_id")


@query(
    "SELECT event_id, hand_id, street, player_id, last_value(CASE WHEN aggressive = 1 THEN player_id END IGNORE NULLS) OVER (PARTITION BY hand_id, street ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) last_aggressor FROM actions",
    "actions",
)
def ffill_last_aggressor(spark: SparkSession, d: str) -> DataFrame:
    """Who last acted aggressively on the street before each action."""
    return T.actions(spark, d).select("event_id", "hand_id", "street", "player_id", X.last_before("player_id", F.col("aggressive") == 1, by_street()).alias("last_aggressor"))


@query(
    "SELECT last_aggressor, player_id responder, \"action\", count(*) n FROM (SELECT *, last_value(CASE WHEN aggressive = 1 THEN player_id END IGNORE NULLS) OVER (PARTITION BY hand_id, street ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) last_aggressor FROM actions) WHERE last_aggressor IS NOT NULL AND last_aggressor <> player_id GROUP BY ALL",
    "actions",
)
def aggressor_response(spark: SparkSession, d: str) -> DataFrame:
    """How players answer the last aggressor, keyed by that aggressor."""
    log = T.actions(spark, d).withColumn("last_aggressor", X.last_before("player_id", F.col("aggressive") == 1, by_street()))
    return log.where("last_aggressor <> player_id").groupBy("last_aggressor", F.col("player_id").alias("responder"), "action").agg(F.count("*").alias("n"))


@query(
    "SELECT event_id, lag(player_id) OVER w prev_player, lag(\"action\") OVER w prev_action, lead(player_id) OVER w next_player, lead(\"action\", 2) OVER w action_after_next FROM actions WINDOW w AS (PARTITION BY hand_id ORDER BY ts, event_id)",
    "actions",
)
def lag_lead_context(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("hand_id").orderBy("ts", "event_id")
    return T.actions(spark, d).select("event_id", F.lag("player_id").over(w).alias("prev_player"), F.lag("action").over(w).alias("prev_action"), F.lead("player_id").over(w).alias("next_player"), F.lead("action", 2).over(w).alias("action_after_next"))


@query(
    "SELECT event_id, CAST(coalesce(sum(aggressive) OVER (PARTITION BY hand_id, street ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) street_before, CAST(coalesce(sum(aggressive) OVER (PARTITION BY hand_id, player_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) own_before FROM actions",
    "actions",
)
def running_before(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("hand_id", "player_id").orderBy("ts", "event_id")
    return T.actions(spark, d).select("event_id", X.running_before("aggressive", by_street()).cast("long").alias("street_before"), X.running_before("aggressive", own).cast("long").alias("own_before"))


@query(
    "SELECT hand_id, player_id, CASE WHEN folded = 0 THEN rank() OVER (PARTITION BY hand_id, folded ORDER BY contribution DESC) END place FROM seats", "seats"
)
def rank_min_masked(spark: SparkSession, d: str) -> DataFrame:
    """Rank by contribution among the seats that didn't fold; ties share the best place."""
    w = Window.partitionBy("hand_id", "folded").orderBy(F.desc("contribution"))
    return T.seats(spark, d).select("hand_id", "player_id", F.when(F.col("folded") == 0, F.rank().over(w)).cast("long").alias("place"))


@query(
    "SELECT p1, p2, hand_id, (rank() OVER (PARTITION BY p1, p2 ORDER BY lines_1 + lines_2) + (count(*) OVER (PARTITION BY p1, p2, lines_1 + lines_2) - 1) / 2) / count(*) OVER (PARTITION BY p1, p2) AS share FROM pairs",
    "pairs",
)
def avg_rank_pct(spark: SparkSession, d: str) -> DataFrame:
    both = T.pair_hands(spark, d).withColumn("lines", F.col("lines_1") + F.col("lines_2"))
    return both.select("p1", "p2", "hand_id", X.average_rank_share(["p1", "p2"], "lines").alias("share"))


@query("SELECT p1, p2, hand_id, (contribution_1 + contribution_2) / (max(contribution_1 + contribution_2) OVER (PARTITION BY p1, p2) + 1e-6) share_of_max FROM pairs", "pairs")
def ratio_to_max(spark: SparkSession, d: str) -> DataFrame:
    both = T.pair_hands(spark, d).withColumn("pot", F.col("contribution_1") + F.col("contribution_2"))
    return both.select("p1", "p2", "hand_id", X.ratio_to_max("pot", ["p1", "p2"]).alias("share_of_max"))


_INDEXED = "indexed AS (SELECT p1, p2, p.hand_id, started_at, i FROM pairs p JOIN (SELECT hand_id, row_number() OVER (PARTITION BY table_id ORDER BY started_at, hand_id) - 1 i FROM hands) USING (hand_id))"


def indexed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pair hands with the hand's position in its table."""
    return T.pair_hands(spark, d).select("p1", "p2", "hand_id", "started_at", "table_id").join(hand_index(spark, d).select("hand_id", F.col("hand_index").alias("i")), "hand_id")


@query(f"SELECT p1, p2, hand_id, coalesce(i - lag(i) {_PAIR_TIME}), 9999) gap_before, coalesce(lead(i) {_PAIR_TIME}) - i, 9999) gap_after FROM indexed", "pairs", also=_INDEXED)
def gap_prev_next(spark: SparkSession, d: str) -> DataFrame:
    """Distance to the pair's hand before and after; 9999 where there is none."""
    gap = lambda c: F.coalesce(c, F.lit(9999)).cast("long")
    return indexed_pairs(spark, d).select("p1", "p2", "hand_id", gap(F.col("i") - F.lag("i").over(by_pair_time())).alias("gap_before"), gap(F.lead("i").over(by_pair_time()) - F.col("i")).alias("gap_after"))


@query("SELECT a.p1, a.p2, a.hand_id, count(*) near FROM indexed a JOIN indexed b ON a.p1 = b.p1 AND a.p2 = b.p2 AND abs(a.i - b.i) <= 20 GROUP BY ALL", "pairs", also=_INDEXED)
def band_join_count(spark: SparkSession, d: str) -> DataFrame:
    """The pair's hands within 20 positions: a range frame instead of a self-join on the band."""
    w = Window.partitionBy("p1", "p2").orderBy("i").rangeBetween(-20, 20)
    return indexed_pairs(spark, d).select("p1", "p2", "hand_id", F.count("*").over(w).alias("near"))


@query(f"SELECT p1, p2, max(s) most FROM (SELECT p1, p2, CAST(sum(lines_1 + lines_2) {_PAIR_TIME} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) s FROM pairs) GROUP BY 1, 2", "pairs")
def rolling20_max(spark: SparkSession, d: str) -> DataFrame:
    rolled = F.sum(F.col("lines_1") + F.col("lines_2")).over(by_pair_time().rowsBetween(-19, 0))
    return T.pair_hands(spark, d).select("p1", "p2", rolled.alias("s")).groupBy("p1", "p2").agg(F.max("s").alias("most"))


@query(f"SELECT p1, p2, hand_id, CAST(sum(contribution_1) {_PAIR_TIME} ROWS UNBOUNDED PRECEDING) AS BIGINT) / CAST(sum(contribution_1) OVER (PARTITION BY p1, p2) AS BIGINT) share FROM pairs", "pairs")
def cum_share(spark: SparkSession, d: str) -> DataFrame:
    so_far = F.sum("contribution_1").over(by_pair_time().rowsBetween(Window.unboundedPreceding, 0))
    return T.pair_hands(spark, d).select("p1", "p2", "hand_id", (so_far / F.sum("contribution_1").over(Window.partitionBy("p1", "p2"))).alias("share"))


@query("SELECT l_orderkey, l_suppkey, l_partkey, l_quantity, CASE WHEN coalesce(stddev_samp(l_quantity) OVER w, 0) < 1e-6 THEN 0.0 ELSE round((l_quantity - avg(l_quantity) OVER w) / stddev_samp(l_quantity) OVER w, 6) + 0.0 END z FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def zscore_in_group(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity")
    return A.z_scores(rows, ["l_suppkey"], "l_quantity", "z").withColumn("z", X.rounded("z")).select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "z")


@query("SELECT table_id, player_id, n, percent_rank() OVER (PARTITION BY table_id ORDER BY n) share FROM (SELECT table_id, player_id, count(*) n FROM seated GROUP BY 1, 2)", "seated")
def percent_rank_pool(spark: SparkSession, d: str) -> DataFrame:
    own = T.seated(spark, d).groupBy("table_id", "player_id").agg(F.count("*").alias("n"))
    return R.percent_rank(own, ["table_id"], "n", "share", "player_id")


@query(f"SELECT p1, p2, hand_id, row_number() {_PAIR_TIME}) / count(*) OVER (PARTITION BY p1, p2) progress FROM pairs", "pairs")
def progress_share(spark: SparkSession, d: str) -> DataFrame:
    """Chronological position of each hand in its pair, as a share."""
    return T.pair_hands(spark, d).select("p1", "p2", "hand_id", (F.row_number().over(by_pair_time()) / F.count("*").over(Window.partitionBy("p1", "p2"))).alias("progress"))


@query("SELECT p1, p2, hand_id, pot FROM (SELECT p1, p2, hand_id, contribution_1 + contribution_2 pot, row_number() OVER (PARTITION BY p1, p2 ORDER BY contribution_1 + contribution_2 DESC, hand_id) k FROM pairs) WHERE k <= 5", "pairs")
def top5_per_pair(spark: SparkSession, d: str) -> DataFrame:
    """The five largest hands of every pair, ties by hand; Spark limits each group before the shuffle's sort."""
    both = T.pair_hands(spark, d).select("p1", "p2", "hand_id", (F.col("contribution_1") + F.col("contribution_2")).alias("pot"))
    return both.withColumn("k", F.row_number().over(Window.partitionBy("p1", "p2").orderBy(F.desc("pot"), "hand_id"))).where("k <= 5").drop("k")


@query("SELECT p1, p2, count(*) n FROM pairs GROUP BY 1, 2 ORDER BY n DESC, p1, p2 LIMIT 100", "pairs")
def global_top_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A top-100 report: each task's best, then the best of those."""
    return T.pair_hands(spark, d).groupBy("p1", "p2").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p1", "p2").limit(100)


@query("SELECT player_id, table_id, phase FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY started_at, hand_id) k FROM seated) WHERE k = 1", "seated")
def keep_first_by_order(spark: SparkSession, d: str) -> DataFrame:
    """Each player's first seat; a partial aggregate instead of a sort."""
    first = F.min_by(F.struct("table_id", "phase"), F.struct("started_at", "hand_id"))
    return T.seated(spark, d).groupBy("player_id").agg(first.alias("f")).select("player_id", "f.*")


@query("SELECT c_custkey, n_regionkey, ((c_custkey * 7919 + 42) % 10007) % 5 fold FROM (SELECT c_custkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY (c_custkey * 7919 + 42) % 10007, c_custkey) k FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE k <= 40")
def seeded_sample_folds(spark: SparkSession, d: str) -> DataFrame:
    """Forty customers of each region in a seeded order that no partitioning changes, with their folds: a sampling operator."""
    rows = T.table(spark, d, "customer").join(T.table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    order = F.pmod(F.col("c_custkey") * 7919 + 42, F.lit(10007))
    k = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(order, "c_custkey"))
    return rows.withColumn("k", k).where("k <= 40").select("c_custkey", "n_regionkey", X.fold_of("c_custkey", 5, 42).alias("fold"))
