import hashlib
import random

import pytest
from dyadlake.llm import fingerprint as P
from dyadlake.llm import shared as S


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_likeness_is_the_edit_distance():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("ABc") for _ in range(r.randint(0, 20))) for _ in "ab")
        run = min(P.RUN, (min(len(a), len(b)) + 1) // 2)
        common = run and any(a[i : i + run] in b for i in range(len(a) - run + 1))
        want = 1.0 if a == b else 2 * lcs(a, b) / (len(a) + len(b)) if common else 0.0
        assert P.alike(a, b) == pytest.approx(want)


def pieces(data, level):
    """Boundaries by the definition: a window of seven bytes, clipped at the start."""
    out, start = [], 0
    import numpy as np

    for i in range(len(data)):
        w = np.frombuffer(data[max(0, i - 6) : i + 1], np.uint8)
        h = int(S.mix(S.prefix_sums(w)[-1:])[0])
        if h % (1 << level) == 0:
            out.append(data[start : i + 1])
            start = i + 1
    return out + ([data[start:]] if start < len(data) else [])


@pytest.mark.parametrize("text", ["", "a", "hello world, this is a text", "ab" * 300, "é" * 50 + "the quick brown fox " * 40])
def test_signature_has_a_character_for_each_piece(text):
    level, one, two = P.fingerprint(text.encode()).split(":")
    assert len(one) == len(pieces(text.encode(), int(level))) and len(two) == len(pieces(text.encode(), int(level) + 1))


def test_blocks_do_not_change_the_fingerprint(monkeypatch):
    r = random.Random(2)
    data = bytes(r.randrange(97, 123) for _ in range(5000))
    whole = P.fingerprint(data)
    for k in (64, 1000, 4999):
        monkeypatch.setattr(S, "CHUNK", k)
        S._tables.clear()
        assert P.fingerprint(data) == whole
    monkeypatch.undo()
    S._tables.clear()


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        e = P.edit(t, nxt)
        a, b, c = (P.fingerprint(x.encode()) for x in (t, e, nxt))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, P.likeness(a, b), P.likeness(a, c)))
    return out


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_query_matches_brute_force(spark, ranges):
    r = random.Random(ranges)
    rows = [(i * 3, "".join(r.choice("abé \n") for _ in range(r.choice([0, 1, 5, 400])))) for i in range(60)] + [(7, None), (8, ""), (None, "null id"), (9, "twice"), (9, "twice"), (9, "other")]
    r.shuffle(rows)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, Fingerprint int").repartition(5)
    got = sorted(map(tuple, P.compared_with_next(df, ranges=ranges).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_one_row_empty_table_and_equal_texts(spark):
    df = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    row = P.compared_with_next(df).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert P.compared_with_next(df.limit(0)).count() == 0
    assert P.fingerprints(spark.createDataFrame([(1, "x y z"), (2, "x y z")], "doc_id long, text string")).select("fingerprint").distinct().count() == 1
