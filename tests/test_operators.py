"""Unit fixtures worked out by hand from the formulas."""

import pytest
from dyadlake.functions import expr as X
from dyadlake.operators import aggregates as A
from dyadlake.operators import cards as C
from dyadlake.operators import pairs as P
from dyadlake.operators import ranking as R
from dyadlake.sources import files
from pyspark.sql import Window
from pyspark.sql import functions as F

RANKS, SUITS = "23456789TJQKA", "cdhs"


def card(s):
    return RANKS.index(s[0]) * 4 + SUITS.index(s[1])


def value(spark, hands):
    rows = [(h, [card(c) for c in h.split()]) for h in hands]
    df = spark.createDataFrame(rows, "h string, c array<int>").select("h", C.value(F.col("c")).alias("v"))
    return {r.h: r.v for r in df.collect()}


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize(("a", "b", "points", "code"), [("As", "Ks", 12, 523), ("As", "Ad", 20, 224), ("2c", "2d", 5, 32), ("7h", "2c", -1.5, 107), ("7s", "6s", 6.5, 411), ("Td", "9c", 6, 159)])
def test_starting_hands(spark, a, b, points, code):
    x, y = F.lit(card(a)), F.lit(card(b))
    assert tuple(one(spark, C.chen(x, y), C.hole_class(x, y))) == (points, code)
    assert tuple(one(spark, C.chen(y, x), C.hole_class(y, x))) == (points, code)


def test_categories_and_order(spark):
    hands = ["As Ks Qs Js Ts", "As Ah Ad Ac Kd", "As Ah Ad Kc Kd", "As Js 9s 5s 2s", "As 2h 3d 4c 5s", "As Ah Ad Kc Qd", "As Ah Kd Kc Qd", "As Ah Kd Qc Jd", "As Kd Qc 9c 7d"]
    v = value(spark, hands)
    assert [v[h] // 15**5 for h in hands] == [8, 7, 6, 5, 4, 3, 2, 1, 0]
    assert [v[h] for h in hands] == sorted(v.values(), reverse=True)


def test_best_of_seven(spark):
    v = value(spark, ["As Ah Ad Kc Kd Kh 2c", "2c 3c 4c 5c 6c 7h 8h", "Ac 2c 3c 4c 5c Kc Qd", "2c 2d 3c 3d 4c 4d Ah", "9c Tc Jd Qh Kh As 2d"])
    assert v["As Ah Ad Kc Kd Kh 2c"] == 6 * 15**5 + 12 * 15 + 11
    assert v["2c 3c 4c 5c 6c 7h 8h"] == 8 * 15**5 + 4
    assert v["Ac 2c 3c 4c 5c Kc Qd"] == 8 * 15**5 + 3
    assert v["2c 2d 3c 3d 4c 4d Ah"] == 2 * 15**5 + (2 * 15 + 1) * 15 + 12
    assert v["9c Tc Jd Qh Kh As 2d"] == 4 * 15**5 + 12


def test_scalars(spark):
    lit = F.lit
    got = one(spark, X.transfer(lit(-30), lit(12)), X.transfer(lit(5), lit(12)), X.smoothed(lit(3), lit(5), 0.3, 20), X.shrunk(lit(0.5), lit(0.2), lit(75), 25.0), X.surprise(lit(0.0)), X.ratio(lit(1), lit(0)))
    assert (got[0], got[1]) == (12, 0)
    assert got[2] == pytest.approx(0.36) and got[3] == pytest.approx(0.225) and got[4] == pytest.approx(11.512925) and got[5] is None
    c = X.coincidence(lit(6), lit(100), lit(0.2), lit(0.1))
    assert [round(x, 6) for x in one(spark, c["excess"], c["z"], c["ratio"])] == [4, 2.529822, 2.6]


def test_last_and_running_before(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 0), (3, "c", 1), (4, "a", 0)], "no int, player string, aggressive int")
    w = Window.partitionBy().orderBy("no")
    rows = df.select("no", X.last_before("player", F.col("aggressive") == 1, w).alias("last"), X.running_before("aggressive", w).alias("n")).orderBy("no").collect()
    assert [r.last for r in rows] == [None, "a", "a", "c"] and [r.n for r in rows] == [0, 1, 1, 2]


def test_average_rank_share_with_nulls(spark):
    df = spark.createDataFrame([("k", v) for v in (1, 2, 2, 3)] + [("n", None), ("n", 5)], "k string, v int")
    got = df.select("k", "v", X.average_rank_share(["k"], "v").alias("s")).collect()
    assert sorted(r.s for r in got if r.k == "k") == [0.25, 0.625, 0.625, 1]
    assert {r.v: r.s for r in got if r.k == "n"} == {None: None, 5: 0.5}


def test_expand_equals_self_join(spark):
    df = spark.createDataFrame([(h, p) for h in range(5) for p in range(h)], "hand int, player int")
    a = {tuple(r) for r in P.expand(df, "hand", "player").collect()}
    b = {tuple(r) for r in P.self_join(df, "hand", "player", []).select("hand", "p1", "p2").collect()}
    assert a == b and len(a) == 1 + 3 + 6


def test_out_of_fold_rate_never_sees_its_fold(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("a", 1, 1), ("b", 0, 1)], "k string, fold int, y int")
    got = {(r.k, r.fold): r.encoded for r in A.out_of_fold_rate(df, ["k"], "fold", "y", 10.0).collect()}
    assert got["a", 0] == pytest.approx((1 + 10 * 0.5) / 12)
    assert got["b", 0] == pytest.approx(0.5)  # unseen elsewhere: the prior of the other folds


def test_ranked_over_ties_and_groups(spark):
    rows = [(g, i, i * 7 % 5) for g in "xy" for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, s int")
    got = {(r.g, r.i): (r.place, r.cum_s) for r in R.ranked(df, ["g"], "s", "i", ["s"]).collect()}
    for g in "xy":
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        total = 0
        for place, (_, i, s) in enumerate(order, 1):
            total += s
            assert got[g, i] == (place, total)


def test_metrics(spark):
    df = spark.createDataFrame([("g", 1, 3.0, 1), ("g", 2, 2.0, 0), ("g", 3, 1.0, 1)], "g string, id int, s double, y int")
    assert R.average_precision(df, ["g"], "s", "y", "id").first().ap == pytest.approx(0.833333, abs=1e-6)
    assert R.map_at(df, "g", "s", "y", "id").first().ap == pytest.approx(0.833333, abs=1e-6)
    assert R.auc(df, "s", "y", "y").first().auc == 0.5
    six = spark.createDataFrame([("g", i, float(-i), 1) for i in range(6)], "g string, id int, s double, y int")
    assert R.map_at(six, "g", "s", "y", "id").first().ap == 1
    assert R.ranked(df.limit(0), ["g"], "s", "id").count() == 0


def test_stage_is_computed_once(spark, tmp_path):
    path = f"file://{tmp_path}/stage"
    a = files.stage(spark.range(3).toDF("id"), path)
    b = files.stage(spark.range(9).toDF("id"), path)
    assert a.count() == b.count() == 3
    assert files.stage(spark.range(9).toDF("id"), path, rebuild=True).count() == 9
    with pytest.raises(ValueError, match="columns differ"):
        files.same_columns(spark.range(1).toDF("a"), spark.range(1).toDF("b"))
    assert files.unique_key(spark.createDataFrame([(1,), (1,), (2,)], "k int"), "k").count() == 1


def test_quantiles(spark):
    df = spark.createDataFrame([("a", v) for v in range(1, 11)] + [("b", 5)] + [("c", 1), ("c", 1), ("c", 4), ("c", None)], "g string, v int")
    got = {r.g: (r.d, r.c) for r in R.quantiles(df, ["g"], "v", {"d": 0.9}, {"c": 0.9}).collect()}
    assert got["a"] == (9, pytest.approx(9.1)) and got["b"] == (5, 5.0) and got["c"] == (4, pytest.approx(3.4))
    assert R.quantiles(df, [], "v", {"d": 0.5}).first().d == 4


def test_shares_and_scores_by_counts(spark):
    df = spark.createDataFrame([("k", v) for v in (1, 2, 2, 3)] + [("n", 5)], "k string, v int")
    got = sorted((r.k, r.v, r.s) for r in R.average_rank_share(df, ["k"], "v", "s", "v").collect())
    assert got == [("k", 1, 0.25), ("k", 2, 0.625), ("k", 2, 0.625), ("k", 3, 1.0), ("n", 5, 1.0)]
    got = sorted((r.k, r.v, r.s) for r in R.percent_rank(df, ["k"], "v", "s", "v").collect())
    assert got == [("k", 1, 0.0), ("k", 2, pytest.approx(1 / 3)), ("k", 2, pytest.approx(1 / 3)), ("k", 3, 1.0), ("n", 5, 0.0)]
    z = {(r.k, r.v): r.z for r in A.z_scores(df, ["k"], "v", "z").collect()}
    assert z["n", 5] == 0.0 and z["k", 2] == 0.0 and z["k", 1] == pytest.approx(-1.224745, abs=1e-6)


def test_columns_by_schema(spark):
    from dyadlake.functions import columns as K

    df = spark.createDataFrame([(1, 2.0, "x", True), (2, float("nan"), "y", None)], "a_id int, b_mean double, c string, d_flag boolean")
    assert K.numeric(df, but=["a_id"]) == ["b_mean", "d_flag"] and K.named(df, suffix="_mean") == ["b_mean"] and K.having(df, ["c", "z"]) == ["c"]
    assert K.padded(df, {"z": "double", "c": "string"}).columns == ["a_id", "b_mean", "c", "d_flag", "z"]
    assert [r.b_mean for r in K.finite(df, ["b_mean"]).orderBy("a_id").collect()] == [2.0, 0.0]


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_ties_that_fill_several_ranges(spark, ranges):
    """One value with most of the rows, groups of one row, nulls, and more ranges than values."""
    rows = [(g, i, v) for g, values in (("a", [0] * 120 + list(range(1, 30)) + [50] * 60 + [99]), ("b", [5]), ("c", [None, None, 1, 1, 2]), ("d", [7] * 90)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.i): (r["__low"], r["__ties"], r["__before"], r["__all"]) for r in R.tied(df, ["g"], "v", "i").collect()}
        places = {(r.g, r.i): (r.place, r.cum_i) for r in R.ranked(df, ["g"], "v", "i", ["i"]).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    key = lambda v: -1 if v is None else v
    for g, i, v in rows:
        own = [(key(w), j) for h, j, w in rows if h == g]
        assert got[g, i] == (sum(w < key(v) for w, _ in own), sum(w == key(v) for w, _ in own), sum(x < (key(v), i) for x in own), len(own))
        down = [j for w, j in own if (-w, j) <= (-key(v), i)]
        assert places[g, i] == (len(down), sum(down))
