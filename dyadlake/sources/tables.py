"""The relational tables as an ordered log of episodes: hands, seats and actions, and pairs of actors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadlake.operators import pairs

SPLIT = "1998-12-01"
#: Users that share a table in the event log.
SEATED_USERS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; columns and filters are pushed into its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hand_id, table_id (the customer's region), started_at, phase, priority."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("table_id"))
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(nations, "c_nationkey")
    phase = F.when(F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp_ntz"), "development").otherwise("evaluation")
    return table(spark, sf_dir, "orders").join(buyers, "o_custkey").select(F.col("o_orderkey").alias("hand_id"), "table_id", F.col("o_orderdate").alias("started_at"), phase.alias("phase"), F.col("o_orderpriority").alias("priority"))


def seats(spark: SparkSession, sf_dir: str, by_hand: bool = False) -> DataFrame:
    """(hand_id, player_id): contribution in cents, quantity, lines, part, folded, showdown, players, net. Nets of a hand sum to 0. ``by_hand``: lines are dealt by their hand at once, which takes one exchange in place of two, into as many parts as are set."""
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey") if by_hand else lines
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    one = lines.groupBy(F.col("l_orderkey").alias("hand_id"), F.col("l_suppkey").alias("player_id")).agg(
        F.sum(cents).alias("contribution"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count("*").alias("lines"), F.min("l_partkey").alias("part"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("folded"), F.max((F.col("l_linestatus") == "F").cast("int")).alias("showdown"),
    )
    w = Window.partitionBy("hand_id")
    return one.withColumn("players", F.count("*").over(w)).withColumn("net", F.col("contribution") * F.col("players") - F.sum("contribution").over(w))


def seated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats with their hand's table, time and phase."""
    return seats(spark, sf_dir).join(hands(spark, sf_dir), "hand_id")


def pair_hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p1, p2, hand_id), p1 < p2, with both sides' columns suffixed _1 and _2."""
    return pairs.self_join(seats(spark, sf_dir), "hand_id", "player_id", ["contribution", "quantity", "lines", "folded", "showdown", "net"]).join(hands(spark, sf_dir), "hand_id")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log in hands, a day of six neighbouring users each: event_id, hand_id, ts, player_id, street (quarter of the day), action, amount in cents, aggressive."""
    seat = F.floor(F.col("user_id") / SEATED_USERS)
    return table(spark, sf_dir, "events").select(
        "event_id", (F.date_format(F.col("ts"), "yyyyMMdd").cast("long") * 1000000 + seat).alias("hand_id"), "ts", F.col("user_id").alias("player_id"), F.floor(F.hour("ts") / 6).cast("int").alias("street"),
        F.col("event_type").alias("action"), F.round(F.col("value") * 100).cast("long").alias("amount"), (F.col("event_type") == "purchase").cast("int").alias("aggressive"),
    )


#: The same relations for the oracle.
HANDS = f"hands AS (SELECT o_orderkey hand_id, n_regionkey table_id, o_orderdate started_at, CASE WHEN o_orderdate < TIMESTAMP '{SPLIT}' THEN 'development' ELSE 'evaluation' END phase, o_orderpriority priority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
SEATS = """seats AS (SELECT *, CAST(count(*) OVER (PARTITION BY hand_id) AS BIGINT) players, CAST(contribution * count(*) OVER (PARTITION BY hand_id) - sum(contribution) OVER (PARTITION BY hand_id) AS BIGINT) net FROM (
 SELECT l_orderkey hand_id, l_suppkey player_id, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) contribution, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) quantity, count(*) lines, min(l_partkey) part,
 CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INT) folded, CAST(max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS INT) showdown FROM lineitem GROUP BY 1, 2))"""
SEATED = "seated AS (SELECT * FROM seats JOIN hands USING (hand_id))"
PAIRS = """pairs AS (SELECT a.hand_id, a.player_id p1, b.player_id p2, a.contribution contribution_1, b.contribution contribution_2, a.quantity quantity_1, b.quantity quantity_2, a.lines lines_1, b.lines lines_2, a.folded folded_1, b.folded folded_2,
 a.showdown showdown_1, b.showdown showdown_2, a.net net_1, b.net net_2, table_id, started_at, phase FROM seats a JOIN seats b ON a.hand_id = b.hand_id AND a.player_id < b.player_id JOIN hands h ON h.hand_id = a.hand_id)"""
ACTIONS = "actions AS (SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS BIGINT) * 1000000 + user_id // 6 AS hand_id, ts, user_id player_id, CAST(hour(ts) // 6 AS INT) street, event_type \"action\", CAST(round(value * 100) AS BIGINT) amount, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END aggressive FROM events)"
