import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from dyadlake.llm import periodic_runs as R
from dyadlake.llm import queries


def plain_runs(w, least=R.LEAST):
    """All runs: for every period all stretches that keep it, then those without a smaller one."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            e = i + q
            while e < len(w) and w[e] == w[e - q]:
                e += 1
            if e - i >= max(least, 2 * q) and not any(w[i + r : e] == w[i : e - r] for r in range(1, q)):
                out.append((i, e - i, q))
            i = e - q + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {j for i, n, q in runs for j in range(i + q, i + n)}
    return " ".join(x for j, x in enumerate(w) if j not in gone)


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_by_brute_force(seed, monkeypatch):
    r = random.Random(seed)
    if seed % 2:  # every part by its Z-functions
        monkeypatch.setattr(R, "FEW", -1)
        monkeypatch.setattr(R, "MANY", 0)
    for _ in range(80):
        texts = []
        for _ in range(r.randint(1, 5)):
            n, letters = r.randint(0, 60), "abcde"[: r.choice([1, 2, 2, 3, 5])]
            w = [r.choice(letters) for _ in range(n)]
            if n and r.random() < 0.6:
                a = r.randrange(n)
                p = r.randint(1, max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        n_words, starts, lengths, periods, left = R._of_texts([" ".join(w) for w in texts], R.LEAST)
        for i, w in enumerate(texts):
            got = list(zip(starts[i], lengths[i], periods[i], strict=True))
            assert got == plain_runs(w) and n_words[i] == len(w) and left[i] == collapsed(w, got)


def test_z_function():
    for s in ([], [1], [1, 1, 1, 1], [1, 2, 1, 2, 1, 3, 1, 2]):
        assert R.z_function(s)[1:] == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]


def test_long_agreements_both_ways():
    r = random.Random(3)
    base = [r.randrange(3) for _ in range(700)]
    s = np.array([9, *base, 7, *base, 8])
    a, b = np.array([1, 701, 50]), np.array([702, 1402, 751])
    assert R._agreement(s, a[:1], b[:1], np.array([700]), 1).tolist() == [700]
    assert R._agreement(s, a[1:2], b[1:2], np.array([701]), -1).tolist() == [700]
    assert R._agreement(s, a[2:], b[2:], np.array([600]), 1).tolist() == [600] and R._agreement(s, a[2:], b[2:], np.array([50]), -1).tolist() == [49]


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "ab " * 11), (5, "ab " * 12), (6, "x y " * 7), (6, "x y " * 7), (7, "a b c d e f " * 2), (8, "A a " * 20), (9, " ".join("ab")), (10, "long " * 60_000)]
    df = spark.createDataFrame([(*r, "mine", 5) for r in rows], "doc_id long, text string, RUNS string, n_words int").repartition(3)
    found = R.find(df)
    assert found.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()}
    assert found.where("doc_id = 6").count() == 2
    assert got[1] == got[2] == got[3] == (0, [], "")
    assert got[4] == (11, [], "ab " * 10 + "ab") and got[5] == (12, [(0, 12, 1)], "ab")
    assert got[6] == (14, [(0, 14, 2)], "x y") and got[7] == (12, [(0, 12, 6)], "a b c d e f") and got[8] == (40, [(0, 40, 2)], "A a")
    assert got[9] == (1, [], "a b") and got[10] == (60_000, [(0, 60_000, 1)], "long")
    assert R.find(df.limit(0)).count() == 0
    empty = R.digests(R.find(df.where("doc_id = 1"), keep=["doc_id"]), ["doc_id"]).first()
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(empty) == (1, 0, None, None, None, None, nothing, nothing)


def test_whole_query_by_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op11_periodic_runs(spark, small).collect()
    assert len(rows) == len(docs) and sum(r.n_runs > 0 for r in rows) > 15
    for row in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[row.doc_id] or "")
        h = zlib.crc32(str(row.doc_id).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = plain_runs(w)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        assert (row.n_runs, row.runs_sha256, row.collapsed_sha256) == (len(runs), sha("".join(f"{i},{n},{q}\n" for i, n, q in runs)), sha(collapsed(w, runs)))
        assert (row.start, row.length, row.period, row.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None, None, None, None))
