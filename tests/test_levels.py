"""Table ranks, two-level encodings, balanced folds, routing and the bootstrap, against plain loops."""

import random

import numpy as np
from dyadlake.operators import bootstrap, encoding, folds, routing, table_ranks
from pyspark.sql import functions as F


def shares(values):
    known = [v for v in values if v is not None]
    return [None if v is None else (sum(x < v for x in known) + (sum(x == v for x in known) + 1) / 2) / len(known) for v in values]


def test_table_ranks_with_frequent_values_nulls_and_groups(spark, monkeypatch):
    monkeypatch.setattr(table_ranks, "SAMPLE", 40)  # most rows unseen
    r = random.Random(1)
    rows = [(i, r.choice("ab") if i % 9 else None, r.choice([0.0, 0.0, 0.0, r.random()]), r.choice([None, 1, 2, r.randrange(50)]), r.random(), 5.0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y int, z double, same double").fillna("none", ["g"])
    for ranges in (1, 3, 12):
        got = {x.id: x for x in table_ranks.average_rank_shares(df, ["x", "y", "z", "same"], ["id"], ["g"], ranges=ranges).collect()}
        assert len(got) == 300
        for g in ("a", "b", None):
            own = [w for w in rows if w[1] == g]
            for k, c in enumerate(("x", "y", "z", "same"), 2):
                for w, s in zip(own, shares([w[k] for w in own]), strict=True):
                    v = got[w[0]][f"{c}_pct"]
                    assert (v is None) == (s is None) and (s is None or abs(v - s) < 1e-12)
    whole = {x.id: x.x_pct for x in table_ranks.average_rank_shares(df, ["x"], ["id"]).collect()}
    assert all(abs(whole[w[0]] - s) < 1e-12 for w, s in zip(rows, shares([w[2] for w in rows]), strict=True))
    assert table_ranks.average_rank_shares(df.limit(0), ["x", "y"], ["id"]).count() == 0


def plain_encoding(rows, k, me, y, m):
    seen = [x for x in rows if x["outer"] != k and (me["outer"] == k or x["inner"] != me["inner"])]
    own = [x[y] for x in seen if x["key"] == me["key"]]
    return (sum(own) + m * (sum(x[y] for x in seen) / len(seen))) / (len(own) + m)


def test_two_level_encodings_hide_the_held_out_and_the_own_label(spark, monkeypatch):
    r = random.Random(2)
    rows = [{"id": i, "key": r.choice([None, "hot", "hot", "hot", "b", f"k{i}"]), "outer": r.randrange(3), "inner": r.randrange(4), "y": r.randrange(2), "z": r.randrange(2)} for i in range(240)]
    frame = lambda rows: spark.createDataFrame([tuple(x.values()) for x in rows], "id long, key string, outer int, inner int, y long, z long")
    run = lambda rows: {x.id: x for x in encoding.two_level(frame(rows), ["key"], ["y", "z"], "outer", "inner", 3, 4, 10.0, "id").collect()}
    got = run(rows)
    assert all(abs(got[x["id"]][f"enc_{y}"][k] - plain_encoding(rows, k, x, y, 10.0)) < 1e-12 for x in rows for y in "yz" for k in range(3))
    changed = [{**x, "y": 1 - x["y"]} if x["outer"] == 1 else x for x in rows]  # labels of outer fold 1 reach nothing that its model sees
    again = run(changed)
    assert all(got[i].enc_y[1] == again[i].enc_y[1] for i in got) and any(got[i].enc_y[0] != again[i].enc_y[0] for i in got)
    one = [{**x, "y": 1 - x["y"]} if x["id"] == rows[5]["id"] else x for x in rows]  # nor does a row's own label reach its encoding, for any model
    again = run(one)
    assert got[rows[5]["id"]].enc_y == again[rows[5]["id"]].enc_y and any(got[i].enc_y != again[i].enc_y for i in got)
    monkeypatch.setattr(encoding, "SMALL", 0)  # joined instead of broadcast
    far = run(rows)
    assert len(far) == 240 and all(far[i].enc_y == got[i].enc_y for i in got)


def test_folds_hold_groups_and_are_balanced(spark, monkeypatch):
    r = random.Random(3)
    rows = [(f"g{g}" if g else None, int(r.random() < (0.6 if g % 7 == 0 else 0.05))) for g in range(60) for _ in range(r.choice([3, 5, 40 if g == 9 else 8]))]
    df = spark.createDataFrame(rows, "g string, y int").repartition(5)
    found = {x.g: x.fold for x in folds.balanced(df, "g", "y", 5).collect()}
    assert set(found) == {g for g, _ in rows}
    positives, all_ = np.zeros(5), np.zeros(5)
    for g, y in rows:
        positives[found[g]] += y
        all_[found[g]] += 1
    largest = max(sum(y for h, y in rows if h == g) for g in found)
    assert positives.max() - positives.min() <= largest and all_.max() - all_.min() <= 45
    # the same as dealing one by one, by hand
    groups = sorted(found, key=lambda g: (-round(sum((sum(1 for h, y in rows if h == g and y == c) - sum(1 for h, _ in rows if h == g) / 2) ** 2 for c in (0, 1)), 6), g is not None, g or ""))
    counts = np.array([[sum(1 for h, y in rows if h == g and y == c) for c in (0, 1)] for g in groups], float)
    assert [found[g] for g in groups] == folds.assign(counts, 5)
    monkeypatch.setattr(folds, "GREEDY", 10)
    rest = {x.g: x.fold for x in folds.balanced(df, "g", "y", 5).collect()}
    assert set(rest) == set(found) and [rest[g] for g in groups[:10]] == [found[g] for g in groups[:10]] and len(set(rest.values())) == 5
    assert folds.balanced(df.limit(0), "g", "y", 5).count() == 0


def test_routing_has_an_exact_capacity(spark):
    rows = [(i, float(i % 7), None if i % 5 == 0 else float(i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "pair long, a double, b double")
    mix = {i: round((s + (t or 0.0)) / 2, 12) for (i, _, _), s, t in zip(rows, shares([x[1] for x in rows]), shares([x[2] for x in rows]), strict=True)}
    order = sorted(mix, key=lambda i: (-mix[i], i))
    for budget in (0, 17, 50, 99):
        out = routing.route(df, {"a": 1.0, "b": 1.0}, budget, "pair").collect()
        assert sorted(x.pair for x in out if x.routed) == sorted(order[:budget]) and [x.pair for x in sorted(out, key=lambda x: x.place)] == order
    routed = routing.route(df, {"a": 1.0}, 10, "pair")
    hands = spark.createDataFrame([(p, h, None if h == 3 else float(h % 4), float(-h)) for p in range(50) for h in range(p % 9)], "pair long, hand long, m double, h double")
    got = routing.evidence(routed, hands, "pair", "hand", "m", "h", 3).collect()
    chosen = {x.pair for x in routed.where("routed").collect()}
    for p in range(50):
        own = range(p % 9)
        best = sorted(own, key=lambda h: (h == 3, -(h % 4) if h != 3 else h, h)) if p in chosen else list(own)
        assert [x.hand for x in sorted((x for x in got if x.pair == p), key=lambda x: x.rank)] == best[:3]


def test_bootstrap_sums_and_interval(spark):
    rows = [(k, (k % 11) / 10 - 0.3) for k in range(400)] + [(None, 1.0), (3, None)]
    df = spark.createDataFrame(rows, "k long, v double")
    want = {}
    for draw in range(300):
        w = [sum((k * 7919 + draw * 104729) % 10007 >= c for c in bootstrap.POISSON) for k, v in rows[:400]]
        want[draw] = (sum(x * round(v * bootstrap.SCALE) for x, (_, v) in zip(w, rows[:400], strict=True)), sum(w))
    for parts in (1, 5):
        assert {x.draw: (x.total, x.n) for x in bootstrap.sums(df.repartition(parts), "k", "v", 300).collect()} == want
    got = bootstrap.interval(df, "k", "v", 300).first()
    mean = np.mean([v for _, v in rows[:400]])
    assert got.draws == 300 and got.low < mean < got.high and abs(got.middle - mean) < 0.02 and got.better == 1.0
    assert abs(np.mean([n for _, n in want.values()]) / 400 - 1) < 0.02  # draws of mean 1
    assert bootstrap.interval(df.limit(0), "k", "v", 10).first().draws == 0
