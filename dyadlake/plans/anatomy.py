"""What a pair's two seats held and how far they departed from the table's policy: strengths by street, looseness, second entrants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlake.functions import expr as X
from dyadlake.operators import behaviour as B
from dyadlake.operators import cards as K
from dyadlake.operators import pairs as P
from dyadlake.plans import cards as deals
from dyadlake.plans.behaviour import _POLICY
from dyadlake.plans.registry import query
from dyadlake.sources import tables as T

_CHEN = "chen AS (SELECT p_partkey part, CAST(CASE WHEN hi = lo THEN greatest(5.0, 2 * base) ELSE base + 2 * suited - CASE hi - lo - 1 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 5 END + CASE WHEN hi - lo - 1 <= 1 AND hi < 12 THEN 1 ELSE 0 END END AS DOUBLE) points FROM (SELECT *, CASE hi WHEN 14 THEN 10.0 WHEN 13 THEN 8.0 WHEN 12 THEN 7.0 WHEN 11 THEN 6.0 ELSE hi / 2.0 END base FROM h))"
_HELD = f"{deals._FLOP[1]}, {deals._RIVER[1]}, held AS (SELECT hand_id, player_id, folded, showdown, net, a.v flop, b.v final FROM seats JOIN ({deals._FLOP[0]}) a ON a.p_partkey = part JOIN ({deals._RIVER[0]}) b ON b.p_partkey = part)"


@query(
    """SELECT *, CAST(loser_flop > winner_flop AS INT) loser_beats_flop, CAST(loser_final > winner_final AS INT) loser_beats_final, loser_final // 759375 - winner_final // 759375 AS category_gap, greatest(loser_final, winner_final) // 759375 AS best_category, CAST(loser_folded = 1 AND loser_final > winner_final AS INT) fold_better, CAST(winner_final // 759375 <= 1 AND winner_net > 0 AS INT) weak_won FROM (
 SELECT a.hand_id, a.player_id p1, b.player_id p2, CASE WHEN a.net < b.net THEN a.flop ELSE b.flop END loser_flop, CASE WHEN a.net < b.net THEN b.flop ELSE a.flop END winner_flop, CASE WHEN a.net < b.net THEN a.final ELSE b.final END loser_final, CASE WHEN a.net < b.net THEN b.final ELSE a.final END winner_final, CASE WHEN a.net < b.net THEN a.folded ELSE b.folded END loser_folded, CASE WHEN a.net < b.net THEN b.net ELSE a.net END winner_net FROM held a JOIN held b ON a.hand_id = b.hand_id AND a.player_id < b.player_id)""",
    "seats", also=_HELD,
)
def strength_anatomy(spark: SparkSession, d: str) -> DataFrame:
    """Loser's and winner's exact values on the flop and at the end, and what follows from them; a tie makes the second the loser."""
    values = deals.values(spark, d, flop=5, final=7).withColumnRenamed("p_partkey", "part")
    held = T.seats(spark, d).select("hand_id", "player_id", "part", "folded", "net").join(values, "part")
    both = P.self_join(held, "hand_id", "player_id", ["folded", "net", "flop", "final"])
    first = F.col("net_1") < F.col("net_2")
    role = {f"loser_{c}": X.picked(first, f"{c}_1", f"{c}_2") for c in ("flop", "final", "folded")} | {f"winner_{c}": X.picked(first, f"{c}_2", f"{c}_1") for c in ("flop", "final", "net")}
    rows = both.select("hand_id", "p1", "p2", *[c.alias(k) for k, c in role.items()])
    flag = lambda c: c.cast("int")
    ahead = F.col("loser_final") > F.col("winner_final")
    return rows.withColumns({
        "loser_beats_flop": flag(F.col("loser_flop") > F.col("winner_flop")), "loser_beats_final": flag(ahead),
        "category_gap": K.category(F.col("loser_final")) - K.category(F.col("winner_final")), "best_category": K.category(F.greatest("loser_final", "winner_final")),
        "fold_better": flag((F.col("loser_folded") == 1) & ahead), "weak_won": flag((K.category(F.col("winner_final")) <= 1) & (F.col("winner_net") > 0)),
    })


_LOOSE = "loose AS (SELECT hand_id, player_id, part, folded, points, CASE WHEN folded = 0 THEN -ln(least(greatest(1 - rate, 1e-5), 1.0)) ELSE 0.0 END AS loose, CASE WHEN folded = 1 THEN -ln(least(greatest(rate, 1e-5), 1.0)) ELSE 0.0 END AS tight, rate - folded AS residual FROM seated JOIN (SELECT table_id, lines, (s + 20 * p) / (n + 20) AS rate FROM policy JOIN prior USING (lines)) USING (table_id, lines) JOIN chen USING (part))"


def departures(spark: SparkSession, d: str) -> DataFrame:
    """Each seat's surprise of staying (loose) or folding (tight) under the table's smoothed policy, and its cards' points."""
    seats = T.seated(spark, d).select("hand_id", "player_id", "part", "folded", "table_id", "lines")
    rates = B.policy(seats, ["table_id"], ["lines"], "folded", 20.0).drop("n")
    points = deals.chen_score(spark, d).withColumnRenamed("p_partkey", "part")
    stayed = F.col("folded") == 0
    return seats.join(rates, ["table_id", "lines"]).join(points, "part").select("hand_id", "player_id", "part", "folded", "points", F.when(stayed, X.surprise(1 - F.col("rate"))).otherwise(0.0).alias("loose"), F.when(~stayed, X.surprise("rate")).otherwise(0.0).alias("tight"), (F.col("rate") - F.col("folded")).alias("residual"))


@query(
    "SELECT a.hand_id, a.player_id p1, b.player_id p2, round(a.loose + b.loose, 6) loose_sum, round(least(a.loose, b.loose), 6) loose_min, round(greatest(a.loose, b.loose), 6) loose_max, round(greatest(a.tight, b.tight), 6) tight_max, round(a.residual + b.residual, 6) + 0.0 residual_sum, greatest(a.points, b.points) points_max, least(a.points, b.points) points_min FROM loose a JOIN loose b ON a.hand_id = b.hand_id AND a.player_id < b.player_id",
    "seated", also=f"{_POLICY}, {deals._HOLE}, {_CHEN}, {_LOOSE}",
)
def policy_deviation(spark: SparkSession, d: str) -> DataFrame:
    """How far both members of a pair depart from the policy in a hand."""
    both = P.self_join(departures(spark, d), "hand_id", "player_id", ["loose", "tight", "residual", "points"])
    c = F.col
    return both.select("hand_id", "p1", "p2", F.round(c("loose_1") + c("loose_2"), 6).alias("loose_sum"), F.round(F.least("loose_1", "loose_2"), 6).alias("loose_min"), F.round(F.greatest("loose_1", "loose_2"), 6).alias("loose_max"), F.round(F.greatest("tight_1", "tight_2"), 6).alias("tight_max"), X.rounded(c("residual_1") + c("residual_2")).alias("residual_sum"), F.greatest("points_1", "points_2").alias("points_max"), F.least("points_1", "points_2").alias("points_min"))


@query(
    "SELECT a.hand_id, a.player_id p1, b.player_id p2, CASE WHEN a.part > b.part THEN a.player_id ELSE b.player_id END AS second, CASE WHEN a.part > b.part THEN a.points ELSE b.points END second_points, round(CASE WHEN a.part > b.part THEN a.loose ELSE b.loose END, 6) second_loose, CAST(a.folded = 0 AND b.folded = 0 AND a.points < 5 AND b.points < 5 AS INT) both_junk, CAST(a.folded = 0 AND b.folded = 0 AND (a.points < 5) <> (b.points < 5) AS INT) one_junk, CAST((a.part > b.part AND a.folded = 0 AND a.points < 5) OR (a.part <= b.part AND b.folded = 0 AND b.points < 5) AS INT) second_junk FROM loose a JOIN loose b ON a.hand_id = b.hand_id AND a.player_id < b.player_id",
    "seated", also=f"{_POLICY}, {deals._HOLE}, {_CHEN}, {_LOOSE}",
)
def second_entrant(spark: SparkSession, d: str) -> DataFrame:
    """What the second to enter (by the larger part) held, and weak cards that were played."""
    both = P.self_join(departures(spark, d), "hand_id", "player_id", ["part", "loose", "points", "folded"])
    c = F.col
    later = c("part_1") > c("part_2")
    played = (c("folded_1") == 0) & (c("folded_2") == 0)
    weak_1, weak_2 = c("points_1") < 5, c("points_2") < 5
    weak = (later & (c("folded_1") == 0) & weak_1) | (~later & (c("folded_2") == 0) & weak_2)
    flag = lambda x: x.cast("int")
    return both.select("hand_id", "p1", "p2", X.picked(later, "p1", "p2").alias("second"), X.picked(later, "points_1", "points_2").alias("second_points"), F.round(X.picked(later, "loose_1", "loose_2"), 6).alias("second_loose"), flag(played & weak_1 & weak_2).alias("both_junk"), flag(played & (weak_1 != weak_2)).alias("one_junk"), flag(weak).alias("second_junk"))
