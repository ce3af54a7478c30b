import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from dyadlake.llm import lm_score as L
from dyadlake.llm import queries
from dyadlake.llm import shared as S
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]


def brute(rows, learn):
    c = Counter(w for (_, t), ok in zip(rows, learn, strict=True) if ok for w in toks(t))
    n, v = sum(c.values()), len(c)
    return [(len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t))) for _, t in rows]


ROWS = [(1, "the cat THE dog"), (2, None), (3, ""), (4, "a b c a b c é"), (5, "the unknown xyzzy zz zz"), (5, "the unknown xyzzy zz zz"), (6, "q " * 600_000), (None, "null id")]


@pytest.mark.parametrize("frequent", [1 << 20, 3, 0])
def test_base_score_and_counts(spark, frequent):
    df = spark.createDataFrame([(d, t, 1.0) for d, t in ROWS], "doc_id long, text string, SCORE double")
    learn = [d is not None and d % 2 == 1 for d, _ in ROWS]
    got = sorted(L.score(df, F.col("doc_id") % 2 == 1, frequent=frequent).collect(), key=lambda r: (r.doc_id or 99))
    want = brute(ROWS, learn)
    assert len(got) == len(ROWS)
    for r, (n, known, total, base) in zip(got, want, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0 and math.isfinite(r.score)
        assert r.held_out == (not (r.doc_id is not None and r.doc_id % 2 == 1))


def test_empty_tables(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert L.score(df.limit(0), F.lit(True)).count() == 0
    row = L.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert (row.n_known, row.train_tokens, row.base_score, row.held_out) == (0, 0, 0.0, True)


def test_probabilities_sum_to_one(spark):
    """Over the classes after any history, over the endings of a class, and over known words and the unknown of a class and ending."""
    r = np.random.default_rng(1)
    w = [r.normal(size=(n, k)).astype(np.float32) for n, k in zip(L.ROWS_, L.WIDTHS, strict=True)]
    docs = spark.createDataFrame([("the cat sat on the mat " * 3 + " ".join(f"w{i}" for i in range(99)),)], "text string")
    v = L.Vocabulary(L.count(docs, "text"), 1 << 20)
    h, spelling, begins = L.tokens(["a b the a b w1 w2", "", "x"])
    kind = v.classes(h, spelling)
    rows, kinds, more, own = L.Histories(h, spelling, kind, begins)(0, len(h))
    assert rows.max() < L.ROWS_[0] and more.max() < L.ROWS_[1] and len(own) == (kinds >= L.SINGLES).sum() > 0
    prior, priors = v.priors()
    for weights, p0, x in ((w[0], prior, rows), (w[1], priors[own // L.ENDINGS], more)):
        n = weights.shape[1]
        p = [np.exp(L.log_softmax(L.logits(weights, p0, x), np.full(x.shape[1], k))) for k in range(n)]
        assert np.allclose(sum(p), 1, atol=1e-4)
    words = {"the", "cat", "sat", "on", "mat", *(f"w{i}" for i in range(99))}
    mass = Counter()
    for t in words:
        hash_, spelling, _ = L.tokens([t])
        c = int(v.c[np.searchsorted(v.h, hash_[0])])
        if v.classes(hash_, spelling)[0] >= L.SINGLES:
            mass[int(spelling[0])] += (c + 1) / (v.sizes[spelling[0]] + v.words[spelling[0]] + 1)
    end = L.SHAPES * L.ENDINGS - 1
    if L.END not in v.tops:
        mass[end] += 2 / (v.sizes[end] + v.words[end] + 1)
    assert mass
    for k, m in mass.items():
        assert m + 1 / (v.sizes[k] + v.words[k] + 1) == pytest.approx(1)


def test_histories_stay_within_a_text():
    a, b = (L.tokens(t) for t in (["x the y", "z the z"], ["z the z"]))
    kind = lambda x: np.where(np.arange(len(x[0])) % 4 == 1, 3, L.SINGLES + x[1] // L.ENDINGS)
    fa = L.Histories(a[0], a[1], kind(a), a[2])(4, 8)
    fb = L.Histories(b[0], b[1], kind(b), b[2])(0, 4)
    assert all(np.array_equal(x, y) for x, y in zip(fa, fb, strict=True))


def slow_score(text, v, weights):
    """The score of one text, token by token, from the definitions."""
    words = toks(text)
    known = [L.tokens([w]) if w else L.tokens([""]) for w in words]
    h = [int(k[0][0]) for k in known]
    spelling = [int(k[1][0]) for k in known]
    kind = [int(v.classes(k[0][:1], k[1][:1])[0]) for k in known]
    prior, priors = v.priors()
    top = lambda x, bits: int(x) >> (64 - bits)
    mix = lambda x: int(S.mix(np.array([x & (1 << 64) - 1], np.uint64))[0])
    out = 0.0
    for i in range(len(words)):
        c1, c2 = (kind[i - k] if i >= k else L.CLASSES for k in (1, 2))
        w1, w2 = (h[i - k] if i >= k else k for k in (1, 2))
        s1, s2 = ([k for k in reversed(kind[:i]) if k < L.SINGLES] + [L.SINGLES] * 2)[:2]
        at = L._AT.tolist()
        rows = [c1 * L._N + c2, at[1] + top(w1, L._WORD), at[2] + top(mix(w1 * 3 + w2), L._PAIR), at[3] + s1 * L._S + s2]
        z = prior.astype(float) + sum(weights[0][r].astype(float) for r in rows)
        out += z[kind[i]] - np.log(np.exp(z - z.max()).sum()) - z.max()
        if kind[i] >= L.SINGLES:
            shape, ending = divmod(spelling[i], L.ENDINGS)
            of = L._OF.tolist()
            more = [shape * L._S**2 + s1 * L._S + s2, of[1] + top(mix(w1 * 5 + shape * 4 + 1), L._OWN), of[2] + top(mix(w2 * 5 + shape * 4 + 2), L._SKIP)]
            z = priors[shape].astype(float) + sum(weights[1][r].astype(float) for r in more)
            out += z[ending] - np.log(np.exp(z - z.max()).sum()) - z.max()
            j = int(np.searchsorted(v.h, np.uint64(h[i])))
            c = v.c[j] if j < len(v.h) and v.h[j] == h[i] else 0
            out += math.log((c + 1) / (v.sizes[spelling[i]] + v.words[spelling[i]] + 1))
    return out / math.log(10)


def test_scores_by_a_plain_loop(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id % 5 = 0").unionByName(spark.createDataFrame(ROWS[:6], "doc_id long, text string"), allowMissingColumns=True)
    learn = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))
    _, v, weights = L.fit(docs.where(learn).select("text"))
    assert all(np.abs(w).max() > 0 for w in weights.value)
    got = {(r.doc_id, r.n_tokens): r.score for r in L.score(docs, learn).collect()}
    for r in docs.collect():
        assert got[r.doc_id, len(toks(r.text))] == pytest.approx(slow_score(r.text, v.value, weights.value), rel=1e-4, abs=1e-4)


def test_the_model_does_not_depend_on_partitions(spark, small, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 4000)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    learn = F.col("doc_id") % 7 != 2
    dealt = []
    inner = L.train_round
    monkeypatch.setattr(L, "train_round", lambda d, *a: dealt.append(d) or inner(d, *a))
    found = [dict(L.score(docs.repartition(n), learn).select("doc_id", "score").collect()) for n in (1, 7, 32)]
    sizes = [r["count"] for r in dealt[0].groupBy("fold", "shard").count().collect()]
    assert len(sizes) > 12 and max(sizes) < 4 * sum(sizes) / len(sizes)  # no shard has much more than its part
    assert found[0] == pytest.approx(found[1], rel=1e-12) and found[0] == pytest.approx(found[2], rel=1e-12)
    monkeypatch.setattr(L, "FAN", 3)  # summed in several levels, rounded between them
    assert dict(L.score(docs, learn).select("doc_id", "score").collect()) == pytest.approx(found[0], rel=1e-5)


@pytest.mark.parametrize("tokens, shards", [(0, 1), (5, 1), (24_000, 2), (36_000, 3), (12_000_000, 1000)])
def test_shards_have_one_size_however_many_there_are(tokens, shards):
    assert L.shards_for(tokens, 4000) == shards


def test_beats_the_base_on_held_out_texts(spark, small):
    out = queries.op4_lm_scoring(spark, small)
    row = out.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert row[0] > row[1] and row[2] > 0.8
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = {r.doc_id: w for r, w in zip(docs, brute([(r.doc_id, r.text) for r in docs], [zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for r in docs]), strict=True)}
    for r in out.collect():
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base, rel=1e-9)


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = ["ab cd " * 50, "x" * 300 + " y", ""]
    whole = S.Words(texts, S.NOT_SPACE)
    monkeypatch.setattr(S, "CHUNK", 100)
    S._tables.clear()
    parts = S.Words(texts, S.NOT_SPACE)
    monkeypatch.undo()
    S._tables.clear()
    same = whole.ends - whole.starts <= 100
    assert np.array_equal(whole.hashes[same], parts.hashes[same]) and np.array_equal(whole.first, parts.first)


@pytest.mark.parametrize("parts", [1, 3])
def test_training_sees_every_position(spark, parts):
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    docs = spark.createDataFrame([(t, 0, k % 2, k) for k, t in enumerate(texts)], "text string, fold int, shard int, place long").repartition(parts)
    sc = spark.sparkContext
    v = L.Vocabulary(L.count(docs, "text"), 1 << 20)
    w = L.train_round(docs, sc.broadcast(v), sc.broadcast([np.zeros((n, k), np.float32) for n, k in zip(L.ROWS_, L.WIDTHS, strict=True)]), 0, 2)
    h, spelling, begins = L.tokens(texts)
    rows, _, more, _ = L.Histories(h, spelling, v.classes(h, spelling), begins)(0, len(h))
    for weights, active in zip(w, (rows, more), strict=True):
        assert np.array_equal(np.flatnonzero(np.abs(weights).sum(1)), np.unique(active))


def test_scores_do_not_depend_on_how_many_words_are_sent(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    many, none = ([(r.doc_id, r.score) for r in L.score(df, F.col("doc_id") % 2 == 1, frequent=n).orderBy("doc_id", "score").collect()] for n in (1 << 20, 0))
    assert [d for d, _ in many] == [d for d, _ in none] and [s for _, s in many] == pytest.approx([s for _, s in none], rel=1e-4)
