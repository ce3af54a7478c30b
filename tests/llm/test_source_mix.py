import random
import re
from collections import defaultdict
from fractions import Fraction

from dyadlake.llm import oracles, queries
from dyadlake.llm import source_mix as M

from oracle import same


def water(sizes, weights, budget):
    """Targets by resharing, in fractions."""
    target, free, left = {}, set(sizes), Fraction(budget)
    while free:
        level = left / sum(weights[s] for s in free)
        above = {s for s in free if level * weights[s] >= 3 * sizes[s]}
        if not above:
            return target | {s: level * weights[s] for s in free}
        for s in above:
            target[s] = Fraction(3 * sizes[s])
            left -= target[s]
        free -= above
    return target


def checked(spark, rows, **kw):
    """Takes rows (doc_id, text, source); compares what any order must give."""
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, position string").repartition(3)
    queue = M.prepare(df, **kw)
    got = M.taken(queue).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += count(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water(sizes, {s: k % 3 + 1 for k, s in enumerate(order)}, sum(sizes.values()) if kw.get("budget") is None else kw["budget"])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size) for r in got) == sorted((i is not None, i or 0, count(t)) for i, t, _ in rows)
    source_of = {(i, count(t)): s for i, t, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-9 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(-1 < taken[s] - want[s] <= 0 for s in sizes)
    return queue, got


def test_shares_limits_and_order(spark):
    r = random.Random(5)
    rows = [(i, "w " * r.choice([0, 1, 3, 40, 500]), r.choice(["a", "b", "B", "é", "", None])) for i in range(400)]
    rows += [(1000 + i, "w " * 7, "tiny") for i in range(3)] + [(2000, "w " * 9000, "one"), (2001, None, "blank"), (2002, " \t", "blank")]
    queue, got = checked(spark, rows)
    mix = M.copies(queue).orderBy("position").collect()
    at = 0
    for a, b in zip(mix, mix[1:], strict=False):
        assert a.position == at and (a.finish, a.number) <= (b.finish, b.number)
        at += a.words
    assert sum(x.words for x in mix) == sum(x.taken for x in got)
    assert sorted(M.taken(M.prepare(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7))).collect()) == sorted(got)


def test_budgets_and_weights(spark):
    rows = [(i, "w " * (i % 9), "abc"[i % 3]) for i in range(90)]
    for budget in (0, 1, 100, 700, 5000):  # the last is above three times all
        checked(spark, rows, budget=budget)
    weights = spark.createDataFrame([(False, "a", 1), (False, "b", 1), (False, "c", 2)], "no_source boolean, source string, weight long")
    queue = M.prepare(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=weights)
    assert {r.source_size: r.target for r in queue.collect()} == {90: 90.0, 120: 90.0, 150: 180.0}


def test_defined_results(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (None, None, None), (2, "d e f", None), (3, "", "")]
    checked(spark, rows)
    checked(spark, [(1, None, None), (2, " ", "x")])
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.taken(M.prepare(empty)).count() == 0
    checked(spark, [(1, "w " * 300_000, "s"), (2, "w", "t")])


def test_no_python_in_the_plan(spark, small):
    plan = queries.op12_source_mix(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_oracle(spark, small):
    assert same(queries.op12_source_mix(spark, small), oracles.OP12, small) == 200
