"""How the members of a pair answer each other within a hand: action context, roles, timing and templates.

A hand has a bounded number of seats, so all windows here run over one hand, and pairs of a hand are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadlake.functions import expr as X
from dyadlake.operators import pairs as P

SEATS = 6
NEVER = 99


def context(log: DataFrame) -> DataFrame:
    """Per action: its number, who was aggressive last on the street, how many players are left, and whether its player folded before."""
    by_hand = Window.partitionBy("hand_id").orderBy("ts", "event_id")
    by_street = Window.partitionBy("hand_id", "street").orderBy("ts", "event_id")
    own = Window.partitionBy("hand_id", "player_id").orderBy("ts", "event_id")
    fold = (F.col("action") == "fold").cast("int")
    df = log.withColumns({"action_no": F.row_number().over(by_hand), "last_aggressor": X.last_before("player_id", F.col("action") == "raise", by_street), "folds_before": X.running_before(fold, own)})
    first_fold = F.when((F.col("action") == "fold") & (F.col("folds_before") == 0), 1).otherwise(0)
    return df.withColumn("active", (F.lit(SEATS) - X.running_before(first_fold, by_hand)).cast("long"))


def member_actions(ctx: DataFrame) -> DataFrame:
    """Every action of both members of every pair of a hand, with what it faces: its partner's aggression, another's, or none."""
    seats = ctx.select("hand_id", "player_id").distinct()
    both = P.members(P.self_join(seats, "hand_id", "player_id", []), ["hand_id"])
    rows = both.join(ctx.withColumnRenamed("player_id", "member"), ["hand_id", "member"])
    facing = F.col("last_aggressor").isNotNull() & (F.col("last_aggressor") != F.col("member"))
    return rows.withColumns({"facing_partner": facing & (F.col("last_aggressor") == F.col("partner")), "facing_other": facing & (F.col("last_aggressor") != F.col("partner"))})


def responses(actions: DataFrame) -> DataFrame:
    """(p1, p2, hand_id): folds, calls and raises against the partner and against others, by street where it matters."""
    is_ = lambda a: F.col("action") == a
    n = X.count_if
    early = F.col("street") == 0
    counts = {}
    for who in ("partner", "other"):
        for a in ("fold", "call", "raise"):
            counts[f"{a}_to_{who}"] = n(F.col(f"facing_{who}") & is_(a))
    counts |= {"fold_to_partner_early": n(F.col("facing_partner") & is_("fold") & early), "first_raises": n(is_("raise") & (F.col("is_first") == 1)), "second_raises": n(is_("raise") & (F.col("is_first") == 0)), "checks": n(is_("check")), "heads_up": n(F.col("active") == 2)}
    return actions.groupBy("p1", "p2", "hand_id").agg(*[c.alias(k) for k, c in counts.items()])


def outsider_responses(ctx: DataFrame) -> DataFrame:
    """(p1, p2, hand_id): how players outside the pair answer its aggression."""
    seats = ctx.select("hand_id", "player_id").distinct()
    both = P.members(P.self_join(seats, "hand_id", "player_id", []), ["hand_id"])
    answers = ctx.where(F.col("last_aggressor").isNotNull() & (F.col("last_aggressor") != F.col("player_id"))).select("hand_id", F.col("last_aggressor").alias("member"), "player_id", "action")
    rows = both.join(answers, ["hand_id", "member"]).where("player_id <> partner")
    return rows.groupBy("p1", "p2", "hand_id").agg(*[X.count_if(F.col("action") == a).alias(f"outsider_{a}") for a in ("fold", "call", "raise")])


def anatomy(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """Flags of a pair's hand, from both kinds of responses."""
    c = F.col
    both = inside.join(outside, ["p1", "p2", "hand_id"], "left").fillna(0)
    flag = lambda x: x.cast("int")
    squeeze = (c("first_raises") > 0) & (c("second_raises") > 0) & (c("outsider_fold") >= 1)
    return both.select("p1", "p2", "hand_id", flag(c("call_to_partner") >= 2).alias("multi_call"), flag(squeeze).alias("squeeze"), flag(squeeze & (c("fold_to_partner") >= 1)).alias("squeeze_then_fold"), flag((c("checks") >= 2) & (c("first_raises") + c("second_raises") == 0)).alias("checkdown"))


def timing(ctx: DataFrame) -> DataFrame:
    """(hand_id, player_id): first and last street, the street of the first fold (``NEVER`` without one), and players left at the last action."""
    fold = F.min(F.when(F.col("action") == "fold", F.col("street")))
    return ctx.groupBy("hand_id", "player_id").agg(F.min("street").alias("first_street"), F.max("street").alias("last_street"), F.coalesce(fold, F.lit(NEVER)).alias("fold_street"), F.min_by("active", -F.col("action_no")).alias("active_at_last"))


def role_token(net_own: Column, net_partner: Column) -> Column:
    """W or L of the pair's two, by net; a tie makes the first the winner."""
    return F.when(net_own > net_partner, "W").when(net_own < net_partner, "L").otherwise(F.when(F.col("is_first") == 1, "W").otherwise("L"))


def templates(actions: DataFrame, nets: DataFrame) -> DataFrame:
    """(p1, p2, hand_id): the members' actions as ordered tokens, role + street + what they face + ':' + two letters. ``nets``: hand_id, player_id, net."""
    side = lambda k: nets.select("hand_id", F.col("player_id").alias(k), F.col("net").alias(f"net_{k}"))
    rows = actions.join(side("member"), ["hand_id", "member"]).join(side("partner"), ["hand_id", "partner"])
    faces = F.when(F.col("facing_partner"), "p").when(F.col("facing_other"), "o").otherwise("-")
    token = F.concat(role_token(F.col("net_member"), F.col("net_partner")), F.col("street").cast("string"), faces, F.lit(":"), F.substring("action", 1, 2))
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("action_no", token.alias("t")))), lambda x: x["t"])
    return rows.groupBy("p1", "p2", "hand_id").agg(tokens.alias("t")).select("p1", "p2", "hand_id", F.array_join("t", " ").alias("template"), F.array_join(F.slice("t", 1, 4), " ").alias("opening"), F.size("t").cast("long").alias("n_tokens"))
