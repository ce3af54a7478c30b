import random
import re
import zlib
from collections import Counter

import pytest
from dyadlake.llm import oracles, queries
from dyadlake.llm import spelling as L

from oracle import same


def near(u, v):
    if len(u) < len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(u) == len(v) + 1 and any(u[:i] + u[i + 1 :] == v for i in range(len(u)))


def plain(words):
    """All pairs tried: word to (form, root, n, n_near, form_n)."""
    best, n_near = {}, {}
    for u in words:
        all_near = [v for v in words if near(u, v)]
        n_near[u] = len(all_near)
        b = min(all_near, key=lambda v: (-words[v], v), default=None)
        best[u] = b if b is not None and words[b] >= 5 * words[u] else None
    out = {}
    for u in words:
        root = u
        while best[root]:
            root = best[root]
        out[u] = (best[u], root, words[u], n_near[u], words.get(best[u]))
    return out


def found(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in L.variants(df).collect()}


@pytest.mark.parametrize("seed, letters, n, share", [(1, "ab", 200, 1000), (2, "abé", 500, 2), (3, "aÿßz", 400, 50)])
def test_all_pairs_by_brute_force(spark, monkeypatch, seed, letters, n, share):
    monkeypatch.setattr(L, "SHARE", share)  # the shallow nodes by broadcast, or nearly none
    r = random.Random(seed)
    words = {}
    while len(words) < n:
        words["".join(r.choice(letters) for _ in range(r.randint(1, 9)))] = r.choice([5, 6, 25, 40, 200, 1000, 5000, 25000])
    assert found(spark, words) == plain(words)


def test_equal_neighbours_long_words_and_chains(spark):
    words = {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "b" * 3000: 7, "b" * 3001: 40, "b" * 1500 + "a" + "b" * 1500: 5, "lonely": 9}
    assert found(spark, words) == plain(words)
    assert found(spark, words)["aaaaaa"][1] == "aaaaaaaaa"


def test_prefix_hashes_of_words_longer_than_a_block(monkeypatch):
    short = L._prefixes(["abcé", "abd"])
    assert len(set(short[2][:3].tolist())) == 3 and short[2][:3].tolist() == short[2][4:7].tolist()  # equal prefixes, equal nodes
    assert short[0].tolist() == [0] * 4 + [1] * 3 and short[1].tolist() == [0, 1, 2, 3, 0, 1, 2]
    monkeypatch.setattr(L.S, "CHUNK", 8)
    a, b = L._prefixes(["abcdefghijklmnopqrstu"])[2], L._prefixes(["abcdefghijklmnopqrXtu"])[2]
    assert a[:19].tolist() == b[:19].tolist() and a[19] != b[19] and len(set(a.tolist())) == 21
    assert a[:8].tolist() == L._prefixes(["abcdefgh"])[2].tolist()


def test_words_are_counted_as_edited(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD", 10)
    r = random.Random(4)
    rows = [(r.choice([None, i]), " ".join(r.choice(["Colour", "colOUR", "colours", "ÀÈÌÒÙÝß", "four", "x1y2", "thirteen-fourteen"]) for _ in range(60)) if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame([(*x, 1, "w") for x in rows], "doc_id long, text string, n int, word string").repartition(4)
    for modulus in (199, 3):
        want = Counter()
        for key, text in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % modulus == 0 else run] += 1
        assert {x.word: x.n for x in L.count_words(df, modulus=modulus).collect()} == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}


def test_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert L.variants(L.count_words(df)).count() == L.variants(L.count_words(df.limit(0))).count() == 0


def test_oracle(spark, small):
    assert same(queries.op13_spelling_variants(spark, small), oracles.OP13, small) > 500
