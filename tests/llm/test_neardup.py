import random
import re
from collections import defaultdict

import numpy as np
import pytest
from dyadlake.llm import neardup as N
from dyadlake.llm import oracles, queries
from pyspark.sql import functions as F

from oracle import same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_sets(texts, size):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def brute(rows, size=4):
    sets = brute_sets([t for _, t in rows], size)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return {d: (len(sets[i]), min(groups[find(i)]), d == min(groups[find(i)])) for i, (d, _) in enumerate(rows)}


def corpus(seed, n=150):
    """Originals, exact copies, and near copies whose similarities straddle the limit."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    base = [" ".join(word() for _ in range(r.choice([1, 3, 4, 30, 120]))) for _ in range(n // 6)]
    texts = []
    for _ in range(n):
        w = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = word()
        texts.append(r.choice([" ", "\n", "  "]).join(w).upper() if r.random() < 0.2 else " ".join(w))
    texts += [None, "", " \n", "One", "one", "a b c", "A B C"]
    ids = r.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("group", [2048, 5])
def test_components_match_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(N, "GROUP", group)  # small blocks: large buckets and clusters are split
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, KEPT string, n int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.classes(df, size=4).collect()}
    assert got == brute(rows)


def test_shingles_and_signature():
    texts = ["a b c d e", "a b c d e a b c d", "x", "", "A B c D e"]
    for size in (1, 4, 5):
        sets = list(N.shingles(texts, size))
        assert [len(u) for u in sets] == [len(s) for s in brute_sets(texts, size)]
        assert np.array_equal(sets[0], sets[4])
    u = next(N.shingles(["w%d " % i for i in range(3)] and [" ".join(f"w{i}" for i in range(40_000))], 4))
    v = u[None, :] * N._A[:3, None] + N._B[:3, None]  # blocks of a long set don't matter
    assert np.array_equal(N.signature(u)[:3], v.min(1)) and np.array_equal(N.signature(u)[N.PERMUTATIONS :][:3], v.max(1))


def test_estimate_is_unbiased():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        both, a, b = r.integers(0, 1 << 63, 300, np.uint64), r.integers(0, 1 << 63, 40, np.uint64), r.integers(0, 1 << 63, 40, np.uint64)
        x, y = N.signature(np.concatenate([both, a])), N.signature(np.concatenate([both, b]))
        errors.append((x == y).mean() - 300 / 380)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 80)]
    df = spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in chain + star], "a long, b long")
    got = {r.node: r.component for r in N.components(df).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 180), 100)}
    assert N.components(df.limit(0)).count() == 0


def test_one_of_each(spark):
    same_ = " ".join(f"w{i}" for i in range(30))
    rows = [(1, same_), (2, same_), (3, same_ + " end"), (4, "other words stand here now"), (4, "other words stand here now"), (None, same_), (None, "null"), (5, None), (6, ""), (7, "")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, gone int")
    out = N.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(1, same_), (4, "other words stand here now"), (0, same_), (0, "null"), (5, ""), (6, ""), (7, "")])


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "a b c d " * 400_000), (2, "a b c d " * 400_001), (3, None)], "doc_id long, text string")
    assert N.classes(df.limit(0)).count() == 0 and N.one_of_each(df.limit(0)).count() == 0
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.classes(df, size=4).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (0, 3)}


def test_oracle(spark, small):
    assert same(queries.op10_near_duplicates(spark, small), oracles.OP10, small) == 200


def test_bitmap_holds_every_id(spark):
    ids = spark.range(5000).select((F.col("id") * 37).alias("k"))
    bits, n = N.bitmap(ids, "k")
    slots = np.array([r.s for r in spark.range(200_000).select(N.slots("id", n).alias("s")).collect()])
    hit = N.taken(bits, slots)
    assert hit[np.arange(0, 5000) * 37].all() and hit.mean() < 0.15


def test_no_helper_column_clashes(spark):
    df = spark.createDataFrame([(1, "a b c d e f", True), (2, "a b c d e f", False), (2, "x y", None), (2, "x y", None)], "doc_id long, text string, __gone boolean").withColumn("is_gone", F.lit(1)).withColumn("Whole_Text", F.lit("w"))
    out = N.one_of_each(df)
    assert out.columns == df.columns and sorted((r.doc_id, r["is_gone"]) for r in out.collect())[0] == (1, 1)
