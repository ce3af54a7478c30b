"""Queries over whole tables at two levels: ranks of all pair columns, encodings within folds of folds, balanced folds, routing under a budget and the bootstrap of pairs' precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlake.operators import bootstrap, encoding, folds, ranking, routing, table_ranks
from dyadlake.operators import wide as W
from dyadlake.plans import boosted, wide
from dyadlake.plans.registry import ORACLE_SQL, query
from dyadlake.sources import files

FOLDS, INNER = 3, 5
#: What pairs are ranked by within their table: the means, sums and spreads of everything that ``aggregate_pairs`` has.
RANKED = [*(f"{c}_mean" for c in W.MEAN), *(f"{c}_max" for c in W.MOST), *(f"{c}_top3" for c in W.TOP3), *(f"{c}_sum" for c in W.SUM), "imbalance", "direction"]
_PAIRS = f"agg_ AS (SELECT *, p1 // 6 AS table_id FROM ({ORACLE_SQL['aggregate_pairs']}))"


def _pct(c: str, by: str) -> str:
    return f"(rank() OVER ({by} ORDER BY {c}) + (count(*) OVER ({by + ',' if by else 'PARTITION BY'} {c}) - 1) / 2) / count(*) OVER ({by})"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pair table with its table; a stage that queries share."""
    return files.once(spark, "aggregated_pairs", d, lambda: wide.aggregate_pairs(spark, d).withColumn("table_id", F.floor(F.col("p1") / 6)))


@query(f"SELECT p1, p2, table_id, {', '.join(f'round({_pct(c, 'PARTITION BY table_id')}, 9) AS {c}_pct' for c in RANKED)} FROM agg_", also=_PAIRS)
def pair_table_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The average-rank share of every column of the pair table among the pairs of its table (of six seats, so fifteen pairs at most)."""
    out = table_ranks.shares_within(pairs(spark, d), RANKED, ["table_id"], ["p1", "p2"])
    return out.select("p1", "p2", "table_id", *[F.round(f"{c}_pct", 9).alias(f"{c}_pct") for c in RANKED])


COMBOS = ("combo_both", "combo_roles", "combo_outsider")
SHOWN = ("dump", "checkdown", "squeeze")


def _encoding_sql() -> str:
    """Written from the definition, in long form: what is left of a code's sums without outer fold k, less the row's own inner fold if it is fitted to."""
    own = "coalesce({t}.{v}, 0) - CASE WHEN g.outer_ = g.k THEN 0 ELSE coalesce({u}.{v}, 0) END"
    of = lambda t, u, v: f"({own.format(t=t, u=u, v=v)})"
    value = f"round(({of('e1', 'e2', 's')} + 10.0 * ({of('t1', 't2', 's')} / CAST({of('t1', 't2', 'n')} AS DOUBLE))) / ({of('e1', 'e2', 'n')} + 10.0), 9)"
    long = f"""SELECT hand_id, p1, p2, combo, y, k, {value} AS v FROM long g LEFT JOIN e1 USING (combo, y, code, k) LEFT JOIN e2 USING (combo, y, code, k, inner_) LEFT JOIN t1 USING (combo, y, k) LEFT JOIN t2 USING (combo, y, k, inner_)"""
    fields = ", ".join(f"max(CASE WHEN combo = '{c}' AND y = '{y}' AND k = {k} THEN v END) AS {c}_{y}_{k}" for c in COMBOS for y in SHOWN for k in range(FOLDS))
    return f"SELECT hand_id, p1, p2, {fields} FROM ({long}) GROUP BY 1, 2, 3"


_CODED = f"""coded AS MATERIALIZED (SELECT hand_id, p1, p2, {', '.join(COMBOS)}, {', '.join(SHOWN)}, CAST(table_id % {FOLDS} AS INT) AS outer_, CAST(hand_id % 1000003 % {INNER} AS INT) AS inner_ FROM hands_),
each AS MATERIALIZED ({' UNION ALL '.join(f"SELECT hand_id, p1, p2, '{c}' AS combo, '{y}' AS y, {c} AS code, {y} AS label, outer_, inner_ FROM coded" for c in COMBOS for y in SHOWN)}), folds AS (SELECT unnest(range({FOLDS})) AS k), long AS MATERIALIZED (SELECT * FROM each, folds),
e1 AS MATERIALIZED (SELECT combo, y, code, k, sum(label) AS s, count(*) AS n FROM long WHERE outer_ <> k GROUP BY 1, 2, 3, 4), e2 AS MATERIALIZED (SELECT combo, y, code, k, inner_, sum(label) AS s, count(*) AS n FROM long WHERE outer_ <> k GROUP BY 1, 2, 3, 4, 5),
t1 AS MATERIALIZED (SELECT combo, y, k, sum(label) AS s, count(*) AS n FROM long WHERE outer_ <> k GROUP BY 1, 2, 3), t2 AS MATERIALIZED (SELECT combo, y, k, inner_, sum(label) AS s, count(*) AS n FROM long WHERE outer_ <> k GROUP BY 1, 2, 3, 4)"""


@query(_encoding_sql(), also=f"{wide._ALL}, {wide._HANDS}, {_CODED}")
def two_level_encoding(spark: SparkSession, d: str) -> DataFrame:
    """Three combinations of what was held and who folded, encoded by what hands are evidence of (each family by itself), for every outer fold of tables, without the row's inner fold where it is fitted to."""
    rows = wide.pair_hands(spark, d).select("hand_id", "p1", "p2", *COMBOS, *[F.col(y).cast("long").alias(y) for y in SHOWN], (F.col("table_id") % FOLDS).cast("int").alias("outer"), (F.col("hand_id") % 1000003 % INNER).cast("int").alias("inner"))
    rows = files.stage(rows)
    for c in COMBOS:
        rows = files.stage(encoding.two_level(rows, [c], SHOWN, "outer", "inner", FOLDS, INNER, 10.0, "hand_id", f"{c}_"))
    return rows.select("hand_id", "p1", "p2", *[F.round(F.get(f"{c}_{y}", F.lit(k)), 9).alias(f"{c}_{y}_{k}") for c in COMBOS for y in SHOWN for k in range(FOLDS)])


@query()
def balanced_folds(spark: SparkSession, d: str) -> DataFrame:
    """Sources dealt to five folds whole, so that low quality and toxicity are spread evenly; how many of each class a fold has."""
    docs = boosted.judged(spark, d).select("doc_id", "source", (F.col("label") * 2 + F.coalesce("toxic", F.lit(0))).alias("class"))
    found = folds.balanced(docs, "source", "class", 5)
    return docs.join(F.broadcast(found), "source").groupBy("fold", "class").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"))


BUDGET = 25_000
SIGNALS = {"directed_signal_mean": 1.0, "soft_signal_mean": 1.0, "isolation_signal_mean": 1.0}
_ROUTED = f"""mixed AS (SELECT p1, p2, round(({' + '.join(f'{w} * ({_pct(c, "")})' for c, w in SIGNALS.items())}) / {sum(SIGNALS.values())}, 12) AS mixture FROM agg_),
placed AS (SELECT *, row_number() OVER (ORDER BY mixture DESC, p1 * 1000003 + p2) AS place, row_number() OVER (ORDER BY mixture DESC, p1 * 1000003 + p2) <= least({BUDGET}, (SELECT count(*) FROM mixed) // 4) AS routed FROM mixed)"""


@query(
    f"SELECT p1, p2, place, routed, k AS rank, hand_id FROM (SELECT p.*, h.hand_id, row_number() OVER (PARTITION BY p.p1, p.p2 ORDER BY CASE WHEN routed THEN CAST(h.score_v2 AS DOUBLE) ELSE CAST(h.relevance AS DOUBLE) END DESC, h.hand_id) AS k FROM placed p JOIN hands2_ h ON h.p1 = p.p1 AND h.p2 = p.p2) WHERE k <= 5",
    also=f"{_PAIRS}, {_ROUTED}, hands2_ AS (SELECT * FROM (WITH {wide._ALL}, {wide._HANDS} SELECT hand_id, p1, p2, score_v2, relevance FROM hands_))",
)
def routed_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Five hands of evidence for every pair: of the quarter of pairs (25,000 at most) with the largest mixture of family percentiles by one score, of all others by the heuristic."""
    key = (F.col("p1") * 1000003 + F.col("p2")).alias("pair")
    rows = pairs(spark, d).select("p1", "p2", key, *SIGNALS)
    placed = files.stage(routing.route(rows, SIGNALS, min(BUDGET, rows.count() // 4), "pair"))
    hands = wide.pair_hands(spark, d).select(key, "hand_id", F.col("score_v2").cast("double").alias("model"), F.col("relevance").cast("double").alias("heuristic"))
    found = routing.evidence(placed, hands, "pair", "hand_id", "model", "heuristic")
    return found.join(placed.select("pair", "p1", "p2", F.col("place").cast("long").alias("place")), "pair").select("p1", "p2", "place", "routed", F.col("rank").cast("long").alias("rank"), "hand_id")


DRAWS = 2000
_AP = "(SELECT p1, p2, sum(y * hits / CAST(k AS DOUBLE)) / least(max(relevant), 5) AS ap FROM (SELECT *, sum(y) OVER (PARTITION BY p1, p2 ORDER BY k) AS hits FROM (SELECT p1, p2, y, row_number() OVER (PARTITION BY p1, p2 ORDER BY {s} DESC, hand_id) AS k, sum(y) OVER (PARTITION BY p1, p2) AS relevant FROM shown)) WHERE k <= 5 AND relevant > 0 GROUP BY 1, 2)"
_WEIGHT = " + ".join(f"CASE WHEN h >= {c} THEN 1 ELSE 0 END" for c in bootstrap.POISSON)


@query(
    f"SELECT count(*) AS draws, round(quantile_disc(mean, 0.025), 9) AS low, round(quantile_disc(mean, 0.5), 9) AS middle, round(quantile_disc(mean, 0.975), 9) AS high, avg(CASE WHEN total > 0 THEN 1 ELSE 0 END) AS better FROM (SELECT draw, sum(w * gain) AS total, sum(w * gain) / CAST(sum(w) AS DOUBLE) / 1000000000 AS mean FROM drawn GROUP BY 1 HAVING sum(w) > 0)",
    also=f"""{wide._ALL}, {wide._HANDS}, shown AS MATERIALIZED (SELECT p1, p2, hand_id, greatest(dump, checkdown, squeeze) AS y, CAST(score_v2 AS DOUBLE) AS a, CAST(relevance AS DOUBLE) AS b FROM hands_),
gains AS (SELECT p1 * 1000003 + p2 AS pair, CAST(round((x.ap - z.ap) * 1000000000) AS BIGINT) AS gain FROM {_AP.format(s='a')} x JOIN {_AP.format(s='b')} z USING (p1, p2)),
drawn AS (SELECT draw, gain, {_WEIGHT} AS w FROM (SELECT draw, gain, (pair * 7919 + draw * 104729) % 10007 AS h FROM gains, (SELECT unnest(range({DRAWS})) AS draw)))""",
)
def bootstrap_map(spark: SparkSession, d: str) -> DataFrame:
    """The interval of the difference in mean AP@5 of two scores over the same pairs, from 2,000 resamples of pairs."""
    hands = wide.pair_hands(spark, d).select((F.col("p1") * 1000003 + F.col("p2")).alias("pair"), "hand_id", F.greatest("dump", "checkdown", "squeeze").cast("int").alias("y"), F.col("score_v2").cast("double").alias("a"), F.col("relevance").cast("double").alias("b"))
    hands = files.stage(hands)
    ap = {c: ranking.map_at(hands, "pair", c, "y", "hand_id").withColumnRenamed("ap", f"ap_{c}") for c in "ab"}
    gains = ap["a"].join(ap["b"], "pair").withColumn("gain", F.col("ap_a") - F.col("ap_b"))
    return bootstrap.interval(gains, "pair", "gain", DRAWS).withColumns({c: F.round(c, 9) for c in ("low", "middle", "high")})
