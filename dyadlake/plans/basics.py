"""Scans, projections, filters, conditionals, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlake.functions import expr as X
from dyadlake.operators import pairs as P
from dyadlake.plans.registry import query
from dyadlake.sources import files
from dyadlake.sources import tables as T


@query("SELECT l_orderkey, l_suppkey, CAST(l_quantity AS BIGINT) quantity, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-07-01' AND l_discount > 0.05")
def scan_filter_project(spark: SparkSession, d: str) -> DataFrame:
    date = lambda s: F.lit(s).cast("timestamp_ntz")
    lines = T.table(spark, d, "lineitem").where((F.col("l_shipdate") >= date("1998-01-01")) & (F.col("l_shipdate") < date("1998-07-01")) & (F.col("l_discount") > 0.05))
    return lines.select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("quantity"), "l_shipdate")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A CSV sink and its typed re-read."""
    return files.csv_roundtrip(T.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"))


@query("SELECT p_brand, CAST(count(*) AS BIGINT) n, CAST(sum(p_size) AS BIGINT) size FROM part GROUP BY 1")
def parquet_stage(spark: SparkSession, d: str) -> DataFrame:
    """A memoised stage: computed once, re-read after, checked against its schema."""
    return files.stage(T.table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("size")))


@query("SELECT p_brand, CAST(count(*) AS BIGINT) n FROM part WHERE p_size BETWEEN 10 AND 20 GROUP BY 1")
def named_view_sql(spark: SparkSession, d: str) -> DataFrame:
    """SQL over a DataFrame with bound parameters."""
    return spark.sql("SELECT p_brand, count(*) AS n FROM {parts} WHERE p_size BETWEEN :low AND :high GROUP BY p_brand", args={"low": 10, "high": 20}, parts=T.table(spark, d, "part"))


@query(
    "SELECT p1, p2, hand_id, CASE WHEN net_1 < net_2 THEN p1 ELSE p2 END loser, CASE WHEN net_1 < net_2 THEN contribution_1 ELSE contribution_2 END loser_contribution, CASE WHEN net_1 < net_2 THEN folded_1 ELSE folded_2 END loser_folded, CASE WHEN net_1 < net_2 THEN showdown_2 ELSE showdown_1 END winner_showdown FROM pairs",
    "pairs",
)
def case_roles(spark: SparkSession, d: str) -> DataFrame:
    """Loser and winner columns of a pair; a tie makes the second the loser."""
    first = F.col("net_1") < F.col("net_2")
    return T.pair_hands(spark, d).select("p1", "p2", "hand_id", X.picked(first, "p1", "p2").alias("loser"), *[X.picked(first, f"{c}_1", f"{c}_2").alias(f"loser_{c}") for c in ("contribution", "folded")], X.picked(first, "showdown_2", "showdown_1").alias("winner_showdown"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, least(greatest(l_extendedprice / greatest(l_quantity, 1.0) / 1000.0, 0.5), 2.5) price_ratio FROM lineitem")
def clip_ratio(spark: SparkSession, d: str) -> DataFrame:
    unit = F.col("l_extendedprice") / X.clip("l_quantity", 1.0) / 1000.0
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", X.clip(unit, 0.5, 2.5).alias("price_ratio"))


@query("SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) n_tokens, string_split(p_name, ' ')[1] AS first_token, substr(p_type, 1, 1) AS initial, right(p_brand, 1) AS last_char, length(p_name) - length(replace(p_name, ' ', '')) + 1 AS by_blanks FROM part")
def string_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = X.tokens_in("p_name")
    blanks = F.length("p_name") - F.length(F.replace("p_name", F.lit(" "), F.lit("")))
    return T.table(spark, d, "part").select("p_partkey", F.size(tokens).cast("long").alias("n_tokens"), F.get(tokens, F.lit(0)).alias("first_token"), F.substring("p_type", 1, 1).alias("initial"), F.substring("p_brand", -1, 1).alias("last_char"), (blanks + 1).cast("long").alias("by_blanks"))


@query(
    "SELECT hand_id, len(l) n, list_max(l) most, len(list_distinct(l)) n_distinct, CASE WHEN list_contains(l, 1) THEN 1 ELSE 0 END has_one, l[3] AS third, len(list_filter(l, lambda x: x > 50)) n_high, array_to_string(l[1:2], ',') AS first_two FROM (SELECT hand_id, list(player_id ORDER BY player_id) l FROM seats GROUP BY 1)",
    "seats",
)
def list_ops(spark: SparkSession, d: str) -> DataFrame:
    """Array functions over a hand's ordered players; a missing position is null."""
    one = T.seats(spark, d).groupBy("hand_id").agg(F.array_sort(F.collect_list("player_id")).alias("l"))
    size = lambda c: F.size(c).cast("long")
    return one.select("hand_id", size("l").alias("n"), F.array_max("l").alias("most"), size(F.array_distinct("l")).alias("n_distinct"), F.array_contains("l", 1).cast("int").alias("has_one"), F.get("l", F.lit(2)).alias("third"), size(F.filter("l", lambda x: x > 50)).alias("n_high"), F.array_join(F.slice("l", 1, 2), ",").alias("first_two"))


STREETS = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE -1 END AS code FROM orders")
def map_lookup(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "orders").select("o_orderkey", X.mapped("o_orderpriority", STREETS, -1).alias("code"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_filter(spark: SparkSession, d: str) -> DataFrame:
    poor = T.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return T.table(spark, d, "orders").join(poor, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT d.doc_id, coalesce(quality, -1) quality, coalesce(toxic, 0) toxic, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def null_fill(spark: SparkSession, d: str) -> DataFrame:
    labels = T.table(spark, d, "labels").withColumn("labelled", F.lit(1))
    return T.table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").fillna({"quality": -1, "toxic": 0, "labelled": 0}).select("doc_id", "quality", "toxic", "labelled")


@query("SELECT event_id, CASE WHEN value - 5 <= 0 THEN 0.0 ELSE round(ln(value - 5), 6) + 0.0 END AS log_value, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE round(value / (event_id % 7), 6) + 0.0 END per FROM events")
def sanitize_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Undefined logarithms and quotients become 0."""
    log = F.coalesce(F.log(F.col("value") - 5), F.lit(0.0))
    per = F.coalesce(X.ratio("value", F.col("event_id") % 7), F.lit(0.0))
    return T.table(spark, d, "events").select("event_id", X.rounded(log).alias("log_value"), X.rounded(per).alias("per"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query(
    "SELECT hand_id, player_id, CASE WHEN (folded = 1) <> (showdown = 1) THEN 1 ELSE 0 END AS exactly_one, CASE WHEN NOT (folded = 1 OR showdown = 1) THEN 1 ELSE 0 END AS neither FROM seats", "seats"
)
def boolean_algebra(spark: SparkSession, d: str) -> DataFrame:
    folded, shown = F.col("folded") == 1, F.col("showdown") == 1
    return T.seats(spark, d).select("hand_id", "player_id", (folded != shown).cast("int").alias("exactly_one"), (~(folded | shown)).cast("int").alias("neither"))


@query("SELECT s_suppkey, coalesce(n, 0) n_hands, coalesce(won, 0) won FROM supplier LEFT JOIN (SELECT player_id, count(*) n, CAST(sum(CASE WHEN net > 0 THEN 1 ELSE 0 END) AS BIGINT) won FROM seats GROUP BY 1) ON s_suppkey = player_id", "seats")
def join_left_fill(spark: SparkSession, d: str) -> DataFrame:
    own = T.seats(spark, d).groupBy(F.col("player_id").alias("s_suppkey")).agg(F.count("*").alias("n_hands"), X.count_if(F.col("net") > 0).alias("won"))
    return T.table(spark, d, "supplier").select("s_suppkey").join(own, "s_suppkey", "left").fillna(0, ["n_hands", "won"])


@query(
    "SELECT coalesce(a.player_id, b.player_id) player_id, coalesce(n_development, 0) n_development, coalesce(n_evaluation, 0) n_evaluation FROM (SELECT player_id, count(*) n_development FROM seated WHERE phase = 'development' AND net > 0 GROUP BY 1) a FULL JOIN (SELECT player_id, count(*) n_evaluation FROM seated WHERE phase = 'evaluation' AND net < 0 GROUP BY 1) b ON a.player_id = b.player_id",
    "seated",
)
def join_full_coalesce(spark: SparkSession, d: str) -> DataFrame:
    own = T.seated(spark, d)
    a = own.where("phase = 'development' and net > 0").groupBy("player_id").agg(F.count("*").alias("n_development"))
    b = own.where("phase = 'evaluation' and net < 0").groupBy("player_id").agg(F.count("*").alias("n_evaluation"))
    return a.join(b, "player_id", "full").fillna(0)


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti_integrity(spark: SparkSession, d: str) -> DataFrame:
    lines = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return T.table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query("SELECT hand_id, p1, p2, net_1, net_2 FROM pairs", "pairs")
def pair_self_join(spark: SparkSession, d: str) -> DataFrame:
    return P.self_join(T.seats(spark, d), "hand_id", "player_id", ["net"])


@query("SELECT a.hand_id, a.player_id p1, b.player_id p2 FROM seats a JOIN seats b ON a.hand_id = b.hand_id AND a.player_id < b.player_id", "seats")
def pair_expand(spark: SparkSession, d: str) -> DataFrame:
    return P.expand(T.seats(spark, d), "hand_id", "player_id")


@query(
    "SELECT member, partner, count(*) n, CAST(sum(folded) AS BIGINT) n_folded, CAST(sum(net) AS BIGINT) net FROM (SELECT hand_id, p1 AS member, p2 partner FROM pairs UNION ALL SELECT hand_id, p2, p1 FROM pairs) m JOIN seats s ON s.hand_id = m.hand_id AND s.player_id = m.member GROUP BY 1, 2",
    "pairs",
)
def member_partner_actions(spark: SparkSession, d: str) -> DataFrame:
    """What each member does in the hands shared with each partner."""
    seats = T.seats(spark, d)
    both = P.members(P.self_join(seats, "hand_id", "player_id", []), ["hand_id"])
    own = seats.select("hand_id", F.col("player_id").alias("member"), "folded", "net")
    return both.join(own, ["hand_id", "member"]).groupBy("member", "partner").agg(F.count("*").alias("n"), F.sum("folded").alias("n_folded"), F.sum("net").alias("net"))


@query(
    "SELECT p1, p2, count(*) n_outsiders, CAST(sum(s.folded) AS BIGINT) n_folded, max(s.contribution) most FROM pairs p JOIN seats s ON s.hand_id = p.hand_id AND s.player_id <> p1 AND s.player_id <> p2 GROUP BY 1, 2",
    "pairs",
)
def outsider_join(spark: SparkSession, d: str) -> DataFrame:
    seats = T.seats(spark, d).select("hand_id", "player_id", "folded", "contribution")
    found = P.outsiders(P.self_join(seats, "hand_id", "player_id", []), seats, "hand_id", "player_id")
    return found.groupBy("p1", "p2").agg(F.count("*").alias("n_outsiders"), F.sum("folded").alias("n_folded"), F.max("contribution").alias("most"))


@query(
    "SELECT a.hand_id, a.event_id opener, min(b.event_id) response FROM actions a JOIN actions b ON a.hand_id = b.hand_id AND a.street = b.street AND b.player_id <> a.player_id AND b.\"action\" = 'error' AND (b.ts > a.ts) WHERE a.\"action\" = 'purchase' GROUP BY 1, 2",
    "actions",
)
def event_after_event(spark: SparkSession, d: str) -> DataFrame:
    """The first error of another player after each purchase on a street."""
    log = T.actions(spark, d)
    a = log.where("action = 'purchase'").select("hand_id", "street", F.col("event_id").alias("opener"), F.col("ts").alias("at"), F.col("player_id").alias("own"))
    b = log.where("action = 'error'").select("hand_id", "street", "event_id", "ts", "player_id")
    return a.join(b, ["hand_id", "street"]).where("player_id <> own and ts > at").groupBy("hand_id", "opener").agg(F.min("event_id").alias("response"))


@query(
    "SELECT coalesce(d.p1, e.p1) p1, coalesce(d.p2, e.p2) p2, d.mean_net AS development, e.mean_net AS evaluation FROM (SELECT p1, p2, round(avg(net_1 - net_2), 4) mean_net FROM pairs WHERE phase = 'development' GROUP BY 1, 2) d FULL JOIN (SELECT p1, p2, round(avg(net_1 - net_2), 4) mean_net FROM pairs WHERE phase = 'evaluation' GROUP BY 1, 2) e ON d.p1 = e.p1 AND d.p2 = e.p2",
    "pairs",
)
def phase_swapped_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Each pair's mean of one phase beside that of the other."""
    mean = lambda phase: F.round(F.avg(F.when(F.col("phase") == phase, F.col("net_1") - F.col("net_2"))), 4)
    return T.pair_hands(spark, d).groupBy("p1", "p2").agg(mean("development").alias("development"), mean("evaluation").alias("evaluation"))


@query("SELECT c_custkey id, 'customer' AS kind, c_acctbal balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal, NULL FROM supplier")
def union_relaxed(spark: SparkSession, d: str) -> DataFrame:
    """Frames of different columns stacked by name."""
    a = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "SELECT 'both' AS side, player_id FROM (SELECT player_id FROM seats WHERE net > 4000000 INTERSECT SELECT player_id FROM seats WHERE net < -4000000) UNION ALL SELECT 'winners' AS side, player_id FROM (SELECT player_id FROM seats WHERE net > 4000000 EXCEPT SELECT player_id FROM seats WHERE net < -4000000)",
    "seats",
)
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    own = T.seats(spark, d)
    up, down = own.where("net > 4000000").select("player_id"), own.where("net < -4000000").select("player_id")
    return up.intersect(down).select(F.lit("both").alias("side"), "player_id").union(up.subtract(down).select(F.lit("winners").alias("side"), "player_id"))


@query(
    "SELECT count(*) n, CAST(sum(CASE WHEN a.hand_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) unmatched, CAST(sum(bad) AS BIGINT) unbalanced FROM (SELECT hand_id, CASE WHEN sum(net) <> 0 THEN 1 ELSE 0 END bad FROM seats GROUP BY 1) s LEFT JOIN hands a ON a.hand_id = s.hand_id",
    "seats", "hands",
)
def contract_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows, hands without an order, and hands whose nets don't sum to 0."""
    own = T.seats(spark, d).groupBy("hand_id").agg((F.sum("net") != 0).cast("int").alias("bad"))
    known = T.hands(spark, d).select("hand_id", F.lit(1).alias("known"))
    return own.join(known, "hand_id", "left").agg(F.count("*").alias("n"), X.count_if(F.col("known").isNull()).alias("unmatched"), X.total("bad").alias("unbalanced"))
