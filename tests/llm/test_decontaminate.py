import random
import re

import pytest
from dyadlake.llm import decontaminate as D
from dyadlake.llm import oracles, queries

from oracle import same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, bench, window):
    wins = {}
    for item, t in bench:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[j : j + n]), set()).add(str(item))
    out = []
    for t in docs:
        w = words(t)
        hit, items = set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in wins}:
                k = tuple(w[i : i + n])
                if len(k) == n and k in wins:
                    hit.update(range(i, i + n))
                    items |= wins[k]
        out.append((len(w), len(hit), len(items), D.digest(sorted(items)), bool(hit)))
    return out


def random_case(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice(["a", "B", "b", "cé", "7"]) + r.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    return [text(r.randint(0, 60)) for _ in range(40)] + [None, "", "...", "É É"], [(i, text(r.choice([0, 1, 2, 3, 8]))) for i in range(6)] + [(3, "a b"), (99, None)]


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("blocks", [4_000_000, 12])
def test_brute_force(spark, seed, blocks):
    texts, bench = random_case(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, N_WORDS string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.report(docs, b, window=3, block_chars=blocks, keep=["doc_id"]).collect()}
    want = brute(texts, bench, 3)
    assert got == dict(enumerate(want))
    left = D.remove(docs, b, window=3, block_chars=blocks)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, w in enumerate(want) if not w[4]}


def test_longest_matches_do_not_cross_texts():
    test = D.TestSuffixes([("1", "a b c d")], 2)
    n, ranges, items, matches = D.judge(["x a b c y", "c", "d a", "b c d", None], test)
    assert n == [5, 1, 2, 3, 0]
    assert ranges == [[(1, 4)], [], [], [(0, 3)], []] and items == [["1"], [], [], ["1"], []]
    assert matches == [[(1, 4, 0, "1")], [], [], [(0, 3, 1, "1")], []]


def slow_matches(text, bench, window):
    """Every common run of words of a text and one item, by trying all places."""
    w = words(text)
    found = []
    for name, t in bench:
        own = words(t)
        n = min(window, len(own))
        for i in range(len(w)):
            for j in range(len(own)):
                if i and j and w[i - 1] == own[j - 1]:
                    continue  # not a run's first words
                k = 0
                while i + k < len(w) and j + k < len(own) and w[i + k] == own[j + k]:
                    k += 1
                if n and k >= n:
                    found.append((i, i + k, j, str(name)))
    return D.whole(found)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("pairs", [1 << 21, 40, 1])
def test_longest_matches_by_trying_all_places(seed, pairs, monkeypatch):
    """Whole, some items at a time, and by the automaton; two items' matches never merge."""
    monkeypatch.setattr(D, "PAIRS", pairs)
    texts, bench = random_case(seed)
    texts += ["a b " * 40, "a " * 30 + "b a"]
    bench += [(7, "a b a b a b"), (8, "a a a a a a a b"), (9, "b a b a")]
    _, ranges, _, matches = D.judge(texts, D.TestSuffixes([(str(i), t) for i, t in bench], 3))
    for t, r, m in zip(texts, ranges, matches, strict=True):
        want = slow_matches(t, bench, 3)
        if pairs > 1:
            assert m == want
        assert [x[:2] for x in m] == [x[:2] for x in want]
        for a, b, q, name in m:
            assert words(t)[a:b] in [words(x)[q : q + b - a] for i, x in bench if str(i) == name]
        assert D.union([x[:2] for x in m]) == D.union(r)


def test_long_items_are_cut_and_joined_again(spark):
    item = " ".join(f"w{i % 700}" for i in range(3000))
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(30, 600)) + " y"), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (6, "of it all")], "item_id long, text string")
    rows = {r.doc_id: r for r in D.report(docs, bench, block_chars=400).collect()}
    assert (rows[1].n_hit, rows[1].n_items, rows[2].n_hit) == (570, 1, 0) and rows[1].matches == ["1:571:30:5"]
    assert [r.doc_id for r in D.remove(docs, bench, block_chars=400).collect()] == [2]


def test_empty_tables_repeats_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "q " * 1_500_000 + "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "A, B. c")], "item_id long, text string")
    assert [r.n_hit for r in D.report(docs, b).collect()] == [3, 3, 3, 3]
    assert [r.n_hit for r in D.report(docs, b.limit(0)).collect()] == [0] * 4
    assert D.report(docs.limit(0), b).count() == 0 and D.remove(docs, b).count() == 0


def test_oracle(spark, small):
    assert same(queries.op6_decontamination(spark, small), oracles.OP6, small) == 200


@pytest.mark.parametrize("block_chars", [4_000_000, 20])
def test_items_without_an_id_contaminate(spark, block_chars):
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "x e f g h y"), (3, "other")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c d"), (7, "e f g h")], "item_id long, text string")
    rows = {r.doc_id: r for r in D.report(docs, bench, window=4, block_chars=block_chars).collect()}
    assert [(rows[i].n_hit, rows[i].n_items, rows[i].contaminated) for i in (1, 2, 3)] == [(4, 1, True), (4, 1, True), (0, 0, False)]
    assert rows[1].items_sha256 == D.digest([]) and rows[2].items_sha256 == D.digest(["7"])
    assert [r.doc_id for r in D.remove(docs, bench, window=4, block_chars=block_chars).collect()] == [3]
