"""The wide pair-hand and pair features over the action log: one query for each family, and what pairs are summarised by.

Every layer's columns stand once, in ``operators/wide``; the DataFrame jobs below and the oracle's text are put together from them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadlake.functions import expr as X
from dyadlake.operators import interactions as I
from dyadlake.operators import pairs as P
from dyadlake.operators import table_ranks
from dyadlake.operators import wide as W
from dyadlake.plans import cards as deals
from dyadlake.plans import interactions as plays
from dyadlake.plans.anatomy import _CHEN
from dyadlake.plans.registry import query
from dyadlake.sources import files
from dyadlake.sources import tables as T

BASES = ("fold", "call", "raise", "check")
#: The number of parts, all of which have cards that are dealt to seats.
DEALT = "(SELECT count(*) FROM part)"
COLUMNS = [*W.SEAT, "net", "points", "flop", "turn", "final", *(f"base_{a}" for a in BASES), *W.JUDGED]
_PAIR = ["hand_id", "p1", "p2"]


def part_of(spark: SparkSession, d: str) -> Column:
    """The part whose cards a hand's player holds."""
    return 1 + (F.col("hand_id") * 31 + F.col("player_id") * 17) % T.table(spark, d, "part").count()


def cards(spark: SparkSession, d: str) -> DataFrame:
    """Points and exact values of every part's cards."""
    points = deals.chen_score(spark, d).withColumnRenamed("p_partkey", "part")
    return deals.values(spark, d, flop=5, turn=6, final=7).withColumnRenamed("p_partkey", "part").join(points, "part")


def acts(spark: SparkSession, d: str) -> DataFrame:
    """Actions with their context and their surprise under the population's policy (u) and the player's own smoothed one (own_u); a stage, since several layers read it."""
    return files.once(spark, "acts", d, lambda: _acts(spark, d))


def _acts(spark: SparkSession, d: str) -> DataFrame:
    facing = F.when(F.col("last_aggressor").isNull() | (F.col("last_aggressor") == F.col("player_id")), 0).otherwise(1)
    order = Window.partitionBy("hand_id").orderBy("action_no")
    log = plays.log(spark, d).repartition("hand_id")  # one exchange for all windows, which are within hands
    rows = I.context(log).withColumnRenamed("action", "act").withColumns({"facing": facing, "prev_act": F.lag("act").over(order), "prev_player": F.lag("player_id").over(order)})
    situation = ["street", "facing"]
    own = rows.groupBy("player_id", *situation, "act").agg(F.count("*").alias("c"))
    population = own.groupBy(*situation, "act").agg(F.sum("c").alias("pc"))
    q = F.col("pc") / F.sum("pc").over(Window.partitionBy(*situation)).cast("double")
    table = own.withColumn("n", F.sum("c").over(Window.partitionBy("player_id", *situation))).join(F.broadcast(population.withColumn("q", q)), [*situation, "act"])  # at most streets x 2 x actions rows
    table = table.select("player_id", *situation, "act", F.expr(W.nats("q")).alias("u"), F.expr(W.nats("(c + 5 * q) / (n + 5)")).alias("own_u"))
    return rows.join(table, ["player_id", *situation, "act"])


#: Parts of a hand, of which none sees another's actions: what a member did there is told by these streets alone.
PARTS = {"early": "street <= 1", "late": "street >= 2"}


def judged(spark: SparkSession, d: str, log: DataFrame, part: str = "") -> DataFrame:
    """One row for each hand and player, with base rates and cards; a stage. ``log``: the actions, of the whole hand or of one of its ``PARTS``."""
    return files.once(spark, f"judged_{part}" if part else "judged", d, lambda: _judged(spark, d, log))


def _judged(spark: SparkSession, d: str, log: DataFrame) -> DataFrame:
    named = lambda columns: [F.expr(e).alias(c) for c, e in columns.items()]
    f = log.groupBy("hand_id", "table_id", "player_id").agg(*named(W.SEAT))
    rates = f.groupBy("faced_pf").agg(F.avg("vpip").alias("rv"), F.avg((F.col("pf_raise") > 0).cast("int")).alias("rr"))
    base = f.groupBy("player_id").agg(*[(F.sum(f"n_{a}") / F.sum("n_acts").cast("double")).alias(f"base_{a}") for a in BASES])
    hand = Window.partitionBy("hand_id")
    rows = f.join(F.broadcast(rates), "faced_pf").join(base, "player_id").withColumn("part", part_of(spark, d)).join(cards(spark, d), "part")
    rows = rows.withColumns({"seats": F.count("*").over(hand), "net": F.col("paid") * F.count("*").over(hand) - F.sum("paid").over(hand)})
    return rows.select("hand_id", "table_id", "player_id", "seats", "rv", "rr", *[c for c in COLUMNS if c not in W.JUDGED], *named(W.JUDGED))


#: Of both members' and the others' answers, what follows from who folded to whom.
FOLDS = {"fold_to_partner": "size(filter(folded_to_1, x -> x = p2)) + size(filter(folded_to_2, x -> x = p1))", "outsider_fold": "size(filter(answered, x -> x = p1 OR x = p2)) - fold_to_partner"}
#: What seats and their actions alone don't tell: cards, base rates and all other answers.
HELD = {*(f"{c}_{k}" for c in COLUMNS if c not in W.SEAT and c != "net" for k in "12"), "outsider_best", "outsider_final", *W.INSIDE, *W.OUTSIDE} - set(FOLDS)


def _with_cards(spark: SparkSession, d: str, seats: DataFrame) -> DataFrame:
    """``seats`` with ``dealt``: whether their part is there, without which ``judged`` has no seat. If the parts' keys have no gaps, their range tells; else they are looked up."""
    keys = T.table(spark, d, "part").select(F.col("p_partkey").alias("part"))
    least, most, n = keys.agg(F.min("part"), F.max("part"), F.count_distinct("part")).first()  # one row
    seats = seats.withColumn("part", part_of(spark, d))
    if n and most - least + 1 == n:
        return seats.withColumn("dealt", F.col("part").between(least, most))
    return seats.join(keys.distinct().withColumn("dealt", F.lit(True)), "part", "left").fillna(False, ["dealt"])


def _told_by_seats(spark: SparkSession, d: str, columns: dict[str, str], words: set[str], log: DataFrame) -> DataFrame:
    """``pair_hands`` for columns without cards: the log is exchanged once, by hand, seats hold only what the columns name, and a hand's pairs (of six seats at most) are taken from its list of seats, without a join."""
    seat = {c: e for c, e in W.SEAT.items() if c == "paid" or words & {f"{c}_1", f"{c}_2"}}
    folds = F.collect_list(F.when((F.col("facing") == 1) & (F.col("act") == "fold"), F.col("last_aggressor"))).alias("folded_to")
    seats = log.repartition("hand_id").groupBy("hand_id", "table_id", "player_id").agg(*[F.expr(e).alias(c) for c, e in seat.items()], folds)
    seats = _with_cards(spark, d, seats)
    one = F.when(F.col("dealt"), F.struct("player_id", "table_id", *seat, "folded_to"))
    hands = seats.groupBy("hand_id").agg(F.collect_list(one).alias("s"), F.flatten(F.collect_list("folded_to")).alias("answered"), F.sum(F.when(F.col("dealt"), F.col("paid"))).alias("total")).withColumn("seats", F.size("s").cast("long"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["player_id"] > a["player_id"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = hands.select("hand_id", "seats", "total", "answered", F.explode(pairs).alias("m"))
    rows = rows.select("hand_id", "seats", "answered", F.col("m.a.table_id").alias("table_id"), *[F.col(f"m.{s}.player_id").alias(f"p{k}") for s, k in (("a", "1"), ("b", "2"))], *[F.col(f"m.{s}.{c}").alias(f"{c}_{k}") for s, k in (("a", "1"), ("b", "2")) for c in (*seat, "folded_to")], *[(F.col(f"m.{s}.paid") * F.col("seats") - F.col("total")).alias(f"net_{k}") for s, k in (("a", "1"), ("b", "2"))])
    for c, e in FOLDS.items():
        rows = rows.withColumn(c, F.expr(e).cast("long"))
    return rows.select("hand_id", "table_id", "p1", "p2", *[F.expr(e).alias(c) for c, e in columns.items()])


def pair_hands(spark: SparkSession, d: str, family: str | None = None, part: str = "", only: Sequence[str] = ()) -> DataFrame:
    """hand_id, table_id, p1, p2 and the columns of a family, or of all, or those named in ``only``; only the layers that these columns name are joined. With ``part``, of the pairs who both acted in that part of the hand, from its actions alone."""
    columns = W.FAMILIES[family] if family else {c: W.HAND[c] for c in only or W.HAND}
    words = set(re.findall(r"\w+", " ".join(columns.values())))
    if only and not words & HELD:
        return _told_by_seats(spark, d, columns, words, acts(spark, d).where(PARTS[part]) if part else acts(spark, d))
    named = lambda columns: [F.expr(e).alias(c) for c, e in columns.items()]
    log = acts(spark, d).where(PARTS[part]) if part else acts(spark, d)
    seats = judged(spark, d, log, part) if part else judged(spark, d, log)
    both = P.side(seats, ["hand_id", "table_id", "seats"], "1", COLUMNS, "player_id").join(P.side(seats, ["hand_id"], "2", COLUMNS, "player_id"), "hand_id").where("p1 < p2")
    pairs = P.self_join(seats, "hand_id", "player_id", [])
    members = P.members(pairs, ["hand_id"])
    rows = both
    if words & set(W.INSIDE):
        own = members.join(log.withColumnRenamed("player_id", "member"), ["hand_id", "member"]).withColumns({"fp": F.expr("facing = 1 AND last_aggressor = partner"), "fo": F.expr("facing = 1 AND last_aggressor <> partner")})
        rows = rows.join(own.groupBy(*_PAIR).agg(*named(W.INSIDE)), _PAIR)
    if words & set(W.OUTSIDE):
        answers = members.join(log.where("facing = 1").withColumnRenamed("last_aggressor", "member"), ["hand_id", "member"]).where("player_id <> partner")
        rows = rows.join(answers.groupBy(*_PAIR).agg(*named(W.OUTSIDE)), _PAIR, "left").fillna(0, list(W.OUTSIDE))
    if words & {"outsider_best", "outsider_final"}:
        others = P.outsiders(pairs, seats.select("hand_id", "player_id", "category", "final"), "hand_id", "player_id").groupBy(*_PAIR).agg(F.max("category").alias("outsider_best"), F.max("final").alias("outsider_final"))
        rows = rows.join(others, _PAIR, "left").fillna(-1, ["outsider_best", "outsider_final"])
    return rows.select("hand_id", "table_id", "p1", "p2", *named(columns))


_ACTS_SQL = f"""{plays._CTX}, faced AS (SELECT hand_id, table_id, player_id, street, act, amount, action_no, last_aggressor, active, CASE WHEN last_aggressor IS NULL OR last_aggressor = player_id THEN 0 ELSE 1 END AS facing, lag(act) OVER w AS prev_act, lag(player_id) OVER w AS prev_player FROM ctx WINDOW w AS (PARTITION BY hand_id ORDER BY action_no)),
pop AS (SELECT street, facing, act, count(*) / CAST(sum(count(*)) OVER (PARTITION BY street, facing) AS DOUBLE) AS q FROM faced GROUP BY 1, 2, 3),
mine AS (SELECT player_id, street, facing, act, count(*) AS c, sum(count(*)) OVER (PARTITION BY player_id, street, facing) AS n FROM faced GROUP BY 1, 2, 3, 4),
acts AS MATERIALIZED (SELECT f.*, {W.nats('q')} AS u, {W.nats('(c + 5 * q) / (n + 5)')} AS own_u FROM faced f JOIN pop USING (street, facing, act) JOIN mine USING (player_id, street, facing, act))"""
_SEATS = f"""f AS MATERIALIZED (SELECT hand_id, table_id, player_id, {W.selected(W.SEAT)} FROM acts GROUP BY 1, 2, 3),
rates AS (SELECT faced_pf, avg(vpip) AS rv, avg(CASE WHEN pf_raise > 0 THEN 1 ELSE 0 END) AS rr FROM f GROUP BY 1),
base AS (SELECT player_id, {', '.join(f'sum(n_{a}) / CAST(sum(n_acts) AS DOUBLE) AS base_{a}' for a in BASES)} FROM f GROUP BY 1),
held AS MATERIALIZED (SELECT part, points, a.v AS flop, b.v AS turn, c.v AS final FROM chen JOIN ({deals._FLOP[0]}) a ON a.p_partkey = part JOIN ({deals._TURN[0]}) b ON b.p_partkey = part JOIN ({deals._RIVER[0]}) c ON c.p_partkey = part),
seat AS (SELECT f.* EXCLUDE (part), rv, rr, {', '.join(f'base_{a}' for a in BASES)}, points, flop, turn, final, count(*) OVER (PARTITION BY hand_id) AS seats, CAST(paid * count(*) OVER (PARTITION BY hand_id) - sum(paid) OVER (PARTITION BY hand_id) AS BIGINT) AS net FROM (SELECT *, 1 + (hand_id * 31 + player_id * 17) % {DEALT} AS part FROM f) f JOIN rates USING (faced_pf) JOIN base USING (player_id) JOIN held USING (part)),
judged AS MATERIALIZED (SELECT *, {W.selected(W.JUDGED)} FROM seat)"""
_WIDE = f"""both_ AS (SELECT a.hand_id, a.table_id, a.seats, a.player_id AS p1, b.player_id AS p2, {W.sided(COLUMNS)} FROM judged a JOIN judged b ON a.hand_id = b.hand_id AND a.player_id < b.player_id),
dirs AS (SELECT hand_id, p1, p2, p1 AS member, p2 AS partner, 1 AS is_first FROM both_ UNION ALL SELECT hand_id, p1, p2, p2, p1, 0 FROM both_),
own AS (SELECT d.*, street, act, amount, active, u, own_u, prev_act, prev_player, facing = 1 AND last_aggressor = partner AS fp, facing = 1 AND last_aggressor <> partner AS fo FROM dirs d JOIN acts x ON x.hand_id = d.hand_id AND x.player_id = d.member),
inside AS (SELECT hand_id, p1, p2, {W.selected(W.INSIDE)} FROM own GROUP BY 1, 2, 3),
outside AS (SELECT d.hand_id, p1, p2, {W.selected(W.OUTSIDE)} FROM dirs d JOIN acts x ON x.hand_id = d.hand_id AND x.facing = 1 AND x.last_aggressor = d.member AND x.player_id <> d.partner GROUP BY 1, 2, 3),
others AS (SELECT b.hand_id, p1, p2, max(category) AS outsider_best, max(final) AS outsider_final FROM both_ b JOIN judged j ON j.hand_id = b.hand_id AND j.player_id <> p1 AND j.player_id <> p2 GROUP BY 1, 2, 3),
wide AS (SELECT b.*, {', '.join(f'i.{c}' for c in W.INSIDE)}, {', '.join(f'coalesce(o.{c}, 0) AS {c}' for c in W.OUTSIDE)}, coalesce(outsider_best, -1) AS outsider_best, coalesce(outsider_final, -1) AS outsider_final FROM both_ b JOIN inside i USING (hand_id, p1, p2) LEFT JOIN outside o USING (hand_id, p1, p2) LEFT JOIN others t USING (hand_id, p1, p2))"""
_ALL = f"{_ACTS_SQL}, {deals._HOLE}, {_CHEN}, {deals._FLOP[1]}, {deals._TURN[1]}, {deals._RIVER[1]}, {_SEATS}, {_WIDE}"
_HANDS = f"hands_ AS MATERIALIZED (SELECT hand_id, table_id, p1, p2, {W.selected(W.HAND)} FROM wide)"


def _family(name: str) -> None:
    def family(spark: SparkSession, d: str) -> DataFrame:
        return pair_hands(spark, d, name)

    family.__name__ = f"hand_{name}"
    family.__doc__ = f"The pair-hand columns of the family {name}."
    query(f"SELECT hand_id, table_id, p1, p2, {W.selected(W.FAMILIES[name])} FROM wide", also=_ALL)(family)


for _name in W.FAMILIES:
    _family(_name)

#: Ranked within the pair: what happened in a hand, what was held and who answered whom, and what pairs are summarised by.
RANKED = list(dict.fromkeys([*(c for f in ("flow", "joint", "sums", "policy", "entrant", "surprise", "strength", "interaction", "outsiders", "anatomy") for c in W.FAMILIES[f]), *W.MOST, *W.TOP3]))
TO_MAX = ("pair_contrib", "net_gap", "surp_pair_sum", "transfer_any", "outsider_fold")


@query(
    f"SELECT hand_id, p1, p2, {', '.join(f'round({c} / (CAST(max({c}) OVER p AS DOUBLE) + 1e-6), 6) AS {c}_to_max' for c in TO_MAX)}, {', '.join(f'round((rank() OVER (PARTITION BY p1, p2 ORDER BY {c}) + (count(*) OVER (PARTITION BY p1, p2, {c}) - 1) / 2) / count(*) OVER p, 6) AS {c}_prank' for c in RANKED)} FROM hands_ WINDOW p AS (PARTITION BY p1, p2)",
    also=f"{_ALL}, {_HANDS}",
)
def hand_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Columns relative to the pair's largest, and the average rank shares of all within the pair (a pair has at most a hand a day). The hands share one exchange by pair and are sorted by it once; the ranks of all columns are worked out batch by batch, so a task holds a batch and a pair whatever the tables' size."""
    rows = pair_hands(spark, d, only=RANKED).select(*_PAIR, *RANKED)
    out = table_ranks.shares_within(rows, RANKED, ["p1", "p2"], ["hand_id"], "_prank", TO_MAX, last=True)
    return out.select(*_PAIR, *[F.round(f"{c}_to_max", 6).alias(f"{c}_to_max") for c in TO_MAX], *[F.round(f"{c}_prank", 6).alias(f"{c}_prank") for c in RANKED])


_TOPS = ", ".join(f"row_number() OVER (PARTITION BY p1, p2 ORDER BY CAST({c} AS DOUBLE) DESC, hand_id) AS k_{c}" for c in W.TOP3)
_T = "CAST(sum(transfer_12) AS BIGINT)", "CAST(sum(transfer_21) AS BIGINT)"


@query(
    f"SELECT p1, p2, count(*) AS n, {', '.join(f'{W.mean(c)} AS {c}_mean' for c in W.MEAN)}, {', '.join(f'max({c}) AS {c}_max' for c in W.MOST)}, {', '.join(f"{W.mean(c, f'FILTER (WHERE k_{c} <= 3)')} AS {c}_top3" for c in W.TOP3)}, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}_sum' for c in W.SUM)}, round(abs({_T[0]} - {_T[1]}) / (CAST({_T[0]} + {_T[1]} AS DOUBLE) + 1), 6) AS imbalance, round(avg(loser_is_p1), 6) AS direction FROM (SELECT *, {_TOPS} FROM hands_) GROUP BY 1, 2",
    also=f"{_ALL}, {_HANDS}",
)
def aggregate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pair table: means, maxima, top-3 means and sums of the pair-hand columns, and its asymmetries."""
    rows = files.stage(pair_hands(spark, d))
    there, back = F.sum("transfer_12"), F.sum("transfer_21")
    one = rows.groupBy("p1", "p2").agg(
        F.count("*").alias("n"), *[W.exact_mean(c).alias(f"{c}_mean") for c in W.MEAN], *[F.max(c).alias(f"{c}_max") for c in W.MOST], *[F.sum(c).alias(f"{c}_sum") for c in W.SUM],
        F.round(F.abs(there - back) / ((there + back).cast("double") + 1), 6).alias("imbalance"), F.round(F.avg("loser_is_p1"), 6).alias("direction"),
    )
    # which of equal values are taken makes no difference to their mean
    best = rows.groupBy("p1", "p2").agg(F.least(F.count("*"), F.lit(3)).cast("double").alias("of"), *[F.slice(F.sort_array(F.collect_list(F.rint(F.col(c).cast("double") * 1000000).cast("long")), False), 1, 3).alias(c) for c in W.TOP3])
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return one.join(best.select("p1", "p2", *[(total(c) / F.col("of") / 1000000).alias(f"{c}_top3") for c in W.TOP3]), ["p1", "p2"])


SPREAD = ("net_gap", "transfer_any", "pair_contrib")
_OVER = (10, 20, 40)


@query(
    f"""SELECT p1, p2, count(*) AS n, {', '.join(f'percentile_disc(0.95) WITHIN GROUP (ORDER BY {c}) AS {c}_p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY {c}) AS {c}_p99, round(avg({c}) FILTER (k_{c} <= 5), 6) AS {c}_top5, round(avg(CASE WHEN {c} >= g_{c} THEN 1 ELSE 0 END), 6) AS {c}_rate95, round(max({c}) / (CAST(sum({c}) AS DOUBLE) + 1), 6) AS {c}_share' for c in SPREAD)},
 {', '.join(f'round((count(*) FILTER (transfer_any >= {k * 500}) + 0.1) / (count(*) + 2.0), 6) AS loss_rate_{k}' for k in _OVER)}, {', '.join(f'max(b{k}) AS burst_{k}' for k in (10, 20))}, max(r5) AS rolling_5, round(avg(net_gap) FILTER (late), 6) - round(avg(net_gap) FILTER (NOT late), 6) AS late_delta, round(avg(squeeze) + avg(dump) + avg(checkdown), 6) AS episode_rate
 FROM (SELECT *, {', '.join(f'row_number() OVER (PARTITION BY p1, p2 ORDER BY {c} DESC, hand_id) AS k_{c}' for c in SPREAD)}, {', '.join(f'count(*) OVER (PARTITION BY p1, p2, CAST(floor(least((i - 1) * {k} / m, {k - 1})) AS BIGINT)) AS b{k}' for k in (10, 20))}, CAST(sum(transfer_any) OVER (PARTITION BY p1, p2 ORDER BY hand_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS r5, i * 2 > m AS late
 FROM (SELECT *, row_number() OVER (PARTITION BY p1, p2 ORDER BY hand_id) AS i, count(*) OVER (PARTITION BY p1, p2) AS m FROM hands_), (SELECT {', '.join(f'percentile_disc(0.95) WITHIN GROUP (ORDER BY {c}) AS g_{c}' for c in SPREAD)} FROM hands_)) GROUP BY 1, 2""",
    also=f"{_ALL}, {_HANDS}",
)
def pair_spread(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles, top-5 means, rates over thresholds, smoothed large-loss rates, bursts, rolling sums, concentration and the later half against the earlier, of each pair."""
    from dyadlake.operators import ranking as R

    rows = files.stage(pair_hands(spark, d).select(*_PAIR, *SPREAD, "squeeze", "dump", "checkdown"))
    cuts = None
    for c in SPREAD:
        cut = R.quantiles(rows.select(F.col(c).alias("v")), [], "v", {f"g_{c}": 0.95})
        cuts = cut if cuts is None else cuts.join(F.broadcast(cut))
    w, order = Window.partitionBy("p1", "p2"), Window.partitionBy("p1", "p2").orderBy("hand_id")
    rows = rows.join(F.broadcast(cuts)).withColumns({"i": F.row_number().over(order), "m": F.count("*").over(w)})
    bin_ = lambda k: F.floor(F.least((F.col("i") - 1) * k / F.col("m"), F.lit(k - 1))).cast("long")
    rows = rows.withColumns({**{f"b{k}": F.count("*").over(Window.partitionBy("p1", "p2", bin_(k))) for k in (10, 20)}, "r5": F.sum("transfer_any").over(order.rowsBetween(-4, 0)), "late": F.col("i") * 2 > F.col("m")})
    rows = rows.withColumns({f"k_{c}": F.row_number().over(w.orderBy(F.desc(c), "hand_id")) for c in SPREAD})
    spread = []
    for c in SPREAD:
        spread += [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c})").cast("long").alias(f"{c}_{k}") for q, k in ((0.95, "p95"), (0.99, "p99"))]
        spread += [F.round(F.avg(F.when(F.col(f"k_{c}") <= 5, F.col(c))), 6).alias(f"{c}_top5"), F.round(X.rate(F.col(c) >= F.col(f"g_{c}")), 6).alias(f"{c}_rate95"), F.round(F.max(c) / (F.sum(c).cast("double") + 1), 6).alias(f"{c}_share")]
    rates = [F.round((X.count_if(F.col("transfer_any") >= k * 500) + 0.1) / (F.count("*") + 2.0), 6).alias(f"loss_rate_{k}") for k in _OVER]
    half = F.round(F.avg(F.when(F.col("late"), F.col("net_gap"))), 6) - F.round(F.avg(F.when(~F.col("late"), F.col("net_gap"))), 6)
    episodes = F.round(F.avg("squeeze") + F.avg("dump") + F.avg("checkdown"), 6)
    return rows.groupBy("p1", "p2").agg(F.count("*").alias("n"), *spread, *rates, *[F.max(f"b{k}").alias(f"burst_{k}") for k in (10, 20)], F.max("r5").alias("rolling_5"), half.alias("late_delta"), episodes.alias("episode_rate"))


#: What a member does with the partner is held against what they do in all their other hands.
CONTRAST = ("net", "n_acts", "n_raise", "n_bet", "n_call", "n_fold", "vpip", "post_in", "loose", "junk", "resid", "pf_raise", "surp", "surp_max", "surp_post", "surp_s0", "surp_fold", "surp_call")
_SHRINK = 25.0
_FIELD = lambda c, k: f"(sum_{c}_{k} / CAST(n AS DOUBLE) - (t{k}.{c} - sum_{c}_{k}) / CAST(greatest(t{k}.hands - n, 1) AS DOUBLE)) * n / (n + {_SHRINK})"


@query(
    f"SELECT p1, p2, n, {', '.join(f'round({c}_c1 + {c}_c2, 6) + 0.0 AS {c}_pf_sum, round(abs({c}_c1 - {c}_c2), 6) AS {c}_pf_gap, round(least({c}_c1, {c}_c2), 6) + 0.0 AS {c}_pf_min' for c in CONTRAST)} FROM (SELECT w.p1, w.p2, n, {', '.join(f'{_FIELD(c, k)} AS {c}_c{k}' for c in CONTRAST for k in '12')} FROM with_ w JOIN alone t1 ON t1.player_id = w.p1 JOIN alone t2 ON t2.player_id = w.p2)",
    also=f"{_ACTS_SQL}, {deals._HOLE}, {_CHEN}, {deals._FLOP[1]}, {deals._TURN[1]}, {deals._RIVER[1]}, {_SEATS}, alone AS MATERIALIZED (SELECT player_id, count(*) AS hands, {', '.join(f'sum({c}) AS {c}' for c in CONTRAST)} FROM judged GROUP BY 1), with_ AS MATERIALIZED (SELECT a.player_id AS p1, b.player_id AS p2, count(*) AS n, {', '.join(f'sum({t}.{c}) AS sum_{c}_{k}' for c in CONTRAST for t, k in (('a', '1'), ('b', '2')))} FROM judged a JOIN judged b ON a.hand_id = b.hand_id AND a.player_id < b.player_id GROUP BY 1, 2)",
)
def pair_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Every member's means with the partner less those of all their other hands (totals less what is shared), shrunk by the shared hands: both members' sum, gap and least."""
    seats = judged(spark, d, acts(spark, d)).select("hand_id", "player_id", *[F.col(c).cast("long").alias(c) for c in CONTRAST])
    both = P.side(seats, ["hand_id"], "1", CONTRAST, "player_id").join(P.side(seats, ["hand_id"], "2", CONTRAST, "player_id"), "hand_id").where("p1 < p2")
    rows = both.groupBy("p1", "p2").agg(F.count("*").alias("n"), *[F.sum(f"{c}_{k}").alias(f"{c}_{k}") for c in CONTRAST for k in "12"])
    for k in "12":
        totals = seats.groupBy(F.col("player_id").alias(f"p{k}")).agg(F.count("*").alias("hands"), *[F.sum(c).alias(f"all_{c}") for c in CONTRAST])
        rows = rows.join(totals, f"p{k}")
        field = lambda c: (F.col(f"all_{c}") - F.col(f"{c}_{k}")) / F.greatest(F.col("hands") - F.col("n"), F.lit(1)).cast("double")  # noqa: B023, E731
        rows = rows.select("p1", "p2", "n", *[c for c in rows.columns if c.endswith(("_1", "_2", "_c1"))], *[X.shrunk(F.col(f"{c}_{k}") / F.col("n").cast("double"), field(c), F.col("n"), _SHRINK).alias(f"{c}_c{k}") for c in CONTRAST])
    both_ = lambda c: (F.col(f"{c}_c1"), F.col(f"{c}_c2"))
    return rows.select("p1", "p2", "n", *[e for c in CONTRAST for x, y in [both_(c)] for e in (X.rounded(x + y).alias(f"{c}_pf_sum"), X.rounded(F.abs(x - y)).alias(f"{c}_pf_gap"), X.rounded(F.least(x, y)).alias(f"{c}_pf_min"))])


SCORED = ("score_v2", "relevance")
_TOP = (3, 5, 10)


def _scores_sql(c: str) -> str:
    top = ", ".join(f"sum(x_{c}) FILTER (k_{c} <= {k}) / CAST(count(*) FILTER (k_{c} <= {k}) AS DOUBLE) / 1000000 AS {c}_top{k}" for k in _TOP)
    over = ", ".join(f"count(*) FILTER (x_{c} > g{q}_{c}) AS {c}_n{q}, round(count(*) FILTER (x_{c} > g{q}_{c}) / CAST(count(*) AS DOUBLE), 6) AS {c}_f{q}" for q in (95, 99))
    burst = f"max(b_{c}) / 1000000 AS {c}_burst_max, (max(b_{c}) - avg(b_{c}) FILTER (j = 1)) / 1000000 AS {c}_burst_excess"
    loser = f"round(greatest(avg(loser_is_p1) FILTER (k_{c} <= 5), 1 - avg(loser_is_p1) FILTER (k_{c} <= 5)), 6) AS {c}_same_loser"
    return f"sum(x_{c}) / CAST(count(*) AS DOUBLE) / 1000000 AS {c}_mean, max(x_{c}) / 1000000 AS {c}_max, CAST(sum(x_{c}) AS DOUBLE) / 1000000 AS {c}_sum, percentile_disc(0.9) WITHIN GROUP (ORDER BY x_{c}) / 1000000 AS {c}_p90, {top}, {over}, {burst}, {loser}"


@query(
    f"""SELECT p1, p2, count(*) AS n, {', '.join(map(_scores_sql, SCORED))}, round(sum(transfer_12 + transfer_21) / CAST(count(*) AS DOUBLE), 6) AS transfer_rate, CAST(greatest(sum(transfer_12), sum(transfer_21)) AS BIGINT) AS transfer_dominant, round(abs(CAST(sum(signed_net_diff) AS DOUBLE)) / (CAST(sum(abs(signed_net_diff)) AS DOUBLE) + 1), 6) AS consistency,
 {', '.join(f'round(greatest(sum({a}_to_partner_by_first), sum({a}_to_partner - {a}_to_partner_by_first)) / CAST(sum({a}_to_partner) + 1 AS DOUBLE), 6) AS {a}_partner_asym' for a in ('call', 'fold'))}
 FROM (SELECT *, {', '.join(f'CAST(floor(sum(x_{c}) OVER e / CAST(count(*) OVER e AS DOUBLE)) AS BIGINT) AS b_{c}' for c in SCORED)}, row_number() OVER (PARTITION BY p1, p2, e ORDER BY hand_id) AS j
 FROM (SELECT *, CAST(floor(least((i - 1) * 8 / m, 7)) AS BIGINT) AS e FROM (SELECT *, row_number() OVER (PARTITION BY p1, p2 ORDER BY hand_id) AS i, count(*) OVER (PARTITION BY p1, p2) AS m, {', '.join(f'row_number() OVER (PARTITION BY p1, p2 ORDER BY x_{c} DESC, hand_id) AS k_{c}' for c in SCORED)} FROM marks)) WINDOW e AS (PARTITION BY p1, p2, e)),
 (SELECT {', '.join(f'percentile_disc(0.{q}) WITHIN GROUP (ORDER BY x_{c}) AS g{q}_{c}' for c in SCORED for q in (95, 99))} FROM marks) GROUP BY 1, 2""",
    also=f"{_ALL}, {_HANDS}, marks AS MATERIALIZED (SELECT *, {', '.join(f'CAST(round(CAST({c} AS DOUBLE) * 1000000) AS BIGINT) AS x_{c}' for c in SCORED)} FROM hands_)",
)
def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """How a pair's hands score: mean, largest, sum, ninth decile, best three, five and ten, hands beyond the whole population's 95 and 99 %, bursts over eight stretches, whether the best hands have one loser; and how one-sided the pair is. Scores and the stretches' means are in whole millionths, so their sums don't depend on the order."""
    from dyadlake.operators import ranking as R

    asym = [f"{a}_to_partner{w}" for a in ("call", "fold") for w in ("", "_by_first")]
    rows = pair_hands(spark, d).select(*_PAIR, "loser_is_p1", "transfer_12", "transfer_21", "signed_net_diff", *asym, *[F.round(F.col(c).cast("double") * 1000000).cast("long").alias(f"x_{c}") for c in SCORED])
    rows = files.stage(rows)
    cuts = [R.quantiles(rows.select(F.col(f"x_{c}").alias("v")), [], "v", {f"g{q}_{c}": q / 100 for q in (95, 99)}) for c in SCORED]
    pair = Window.partitionBy("p1", "p2")
    i, m = F.row_number().over(pair.orderBy("hand_id")), F.count("*").over(pair)
    rows = rows.withColumns({"e": F.floor(F.least((i - 1) * 8 / m, F.lit(7))).cast("long"), **{f"k_{c}": F.row_number().over(pair.orderBy(F.desc(f"x_{c}"), "hand_id")) for c in SCORED}})
    stretch = Window.partitionBy("p1", "p2", "e")
    rows = rows.withColumns({**{f"b_{c}": F.floor(F.sum(f"x_{c}").over(stretch) / F.count("*").over(stretch).cast("double")).cast("long") for c in SCORED}, "j": F.row_number().over(stretch.orderBy("hand_id"))})
    for cut in cuts:
        rows = rows.join(F.broadcast(cut))  # one row
    whole = lambda e, name: (e / 1000000).alias(name)
    out = []
    for c in SCORED:
        x, first = F.col(f"x_{c}"), F.when(F.col(f"k_{c}") <= 5, F.col("loser_is_p1"))
        out += [whole(F.sum(x) / F.count("*").cast("double"), f"{c}_mean"), whole(F.max(x), f"{c}_max"), whole(F.sum(x).cast("double"), f"{c}_sum"), whole(F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY x_{c})"), f"{c}_p90")]
        out += [whole(F.sum(F.when(F.col(f"k_{c}") <= k, x)) / F.least(F.count("*"), F.lit(k)).cast("double"), f"{c}_top{k}") for k in _TOP]
        for q in (95, 99):
            above = X.count_if(x > F.col(f"g{q}_{c}"))
            out += [above.alias(f"{c}_n{q}"), F.round(above / F.count("*").cast("double"), 6).alias(f"{c}_f{q}")]
        out += [whole(F.max(f"b_{c}"), f"{c}_burst_max"), whole(F.max(f"b_{c}") - F.avg(F.when(F.col("j") == 1, F.col(f"b_{c}"))), f"{c}_burst_excess"), F.round(F.greatest(F.avg(first), 1 - F.avg(first)), 6).alias(f"{c}_same_loser")]
    there, back = F.sum("transfer_12"), F.sum("transfer_21")
    out += [F.round((there + back) / F.count("*").cast("double"), 6).alias("transfer_rate"), F.greatest(there, back).cast("long").alias("transfer_dominant"), F.round(F.abs(F.sum("signed_net_diff")) / (F.sum(F.abs("signed_net_diff")).cast("double") + 1), 6).alias("consistency")]
    for a in ("call", "fold"):
        mine, all_ = F.sum(f"{a}_to_partner_by_first"), F.sum(f"{a}_to_partner")
        out.append(F.round(F.greatest(mine, all_ - mine) / (all_ + 1).cast("double"), 6).alias(f"{a}_partner_asym"))
    return rows.groupBy("p1", "p2").agg(F.count("*").alias("n"), *out)
