import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from dyadlake.llm import pii as P
from pyspark.sql import functions as F

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 12 <= len(d(m.group())) <= 19 and P.luhn(d(m.group()))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(d(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


@pytest.mark.parametrize("alphabet", ["ab.@-é 1%@", "0123.45. 255", "0123456789 -", "+0123456789 ().-", "a1@.+ -é"])
def test_base_spans_match_the_rules(alphabet):
    r = random.Random(alphabet)
    for _ in range(15_000):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        assert P.base_spans(t) == brute(t), t


def test_luhn():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


ROWS = [
    (1, "mail a.b@c.org or call +1 (614) 555-8001, host 10.0.0.1"), (2, None), (3, ""), (4, "nothing here"), (5, "card 4111 1111 1111 1111 ok"), (6, "x (at) y (dot) com, ssn 123-45-6789"),
    (7, "version 1.2.3.4 and 999.1.1.1"), (7, "version 1.2.3.4 and 999.1.1.1"), (None, "é é@ü a@b.c"), (8, "w " * 700_000 + "z@q.fr"),
]


def test_query_columns_and_edges(spark):
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in ROWS], "doc_id long, text string, SPANS string, n_ip int")
    rows = P.find(df).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    for d, t in ROWS:
        base = brute(t or "")
        assert by[d].base_sha256 == hashlib.sha256(P.joined(base).encode()).hexdigest()
        assert [by[d][f"n_{k}"] for k in P.BASE] == [sum(s[0] == k for s in base) for k in P.BASE]
        spans = by[d].spans.split(",") if by[d].spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans)
    assert by[4].spans == "" and "ssn" in by[6].spans
    assert P.find(df.limit(0)).count() == 0


def test_mask_keeps_everything_else(spark):
    df = spark.createDataFrame([(d, t, len(t or ""), "x") for d, t in ROWS], "doc_id long, text string, n_chars long, spans string")
    out = P.mask(df)
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "mail <EMAIL> or call <PHONE>, host <IP>" and got[4].text == "nothing here" and got[2].text is None
    assert got[5].text == "card <CARD> ok" and got[5].n_chars == len(got[5].text) and got[8].text.endswith("w <EMAIL>")
    assert P.mask(df.limit(0)).count() == 0


def test_masking_overlapping_base_spans(spark):
    assert P.base_spans("+41 11.11.11.11") == [("phone", 0, 15), ("ip", 4, 15)]
    df = spark.createDataFrame([(1, "call +41 11.11.11.11 now")], "doc_id long, text string")
    assert re.fullmatch(r"call (<\w+>)+ now", P.mask(df).first().text)


def test_expectation_maximisation_finds_the_reliable_labeler():
    # truth follows the strict form and the gazetteer; context is noise
    counts = {}
    r = random.Random(1)
    for _ in range(4000):
        y = r.random() < 0.4
        noisy = lambda p, y=y: (1 if y else -1) if r.random() < p else (-1 if y else 1)
        p = P.pattern("number", (noisy(0.95), noisy(0.9), r.choice([0, 1]), 0, r.choice([0, 1]), 1, 2, 1, 1, 1, 1, r.choice([3, 9])))
        counts[p] = counts.get(p, 0) + 1
    model = P.fit(counts)
    good = [model[p] for p in counts if p.startswith("number;1,1")]
    bad = [model[p] for p in counts if p.startswith("number;-1,-1")]
    assert min(good) > 0.8 and max(bad) < 0.2
    assert P.fit({})["number;1,1,0,0,0,1,2,1,1,1,1,3"] == 0


def test_oracle_counts_by_regular_expression(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in P.find(docs).collect()}
    for r in docs.collect():
        base = brute(r.text)
        assert [got[r.doc_id][f"n_{k}"] for k in P.BASE] == [sum(s[0] == k for s in base) for k in P.BASE]
    assert docs.where(F.col("text").isNotNull()).count() == len(got)


def test_fit_follows_the_distribution_and_not_the_size():
    r = random.Random(3)
    shares = {}
    for _ in range(60):
        votes = (r.choice([-1, 1]), r.choice([-1, 0, 1]), r.choice([0, 1]), r.choice([-1, 0]), r.choice([0, 1]), r.choice([-1, 1]), *(r.randrange(k) for k in P.LOOKS))
        shares[P.pattern(r.choice(["number", "ssn", "local_phone"]), votes)] = round(10 ** r.uniform(0, 4))
    small, large = (P.fit({p: n * k for p, n in shares.items()}) for k in (20, 20_000))
    assert max(abs(small[p] - large[p]) for p in shares) < 1e-3


@pytest.mark.parametrize("text", ["0" * 5000 + ".1.1.1 y", "9" * 1_000_000, "0" * 1_000_000 + ".1", "1." * 500_000, "+" * 1_000_000, "+1" * 500_000, "a@" * 500_000, "@" * 1_000_000, "1.1.1.1 " * 125_000, "(at) a" * 160_000, "(1" * 500_000, "AB12 " * 200_000, "+1(" + "(" * 1_000_000, "4111 1111 1111 1111 " * 50_000])
def test_long_runs_take_linear_time(text):
    began = time.process_time()
    found = P.candidates(text)
    assert all(0 <= a < b <= len(text) for _, a, b, _ in found)
    P.choose([(k, a, b, P.pattern(k, v)) for k, a, b, v in found], P.Model(np.zeros(P._AT[-1])), 0.1)
    assert time.process_time() - began < 12


def test_base_of_long_digits_and_zeros():
    assert P.base_spans("x " + "0" * 5000 + ".1.1.1 y") == [("ip", 2, 5008)]
    assert P.base_spans("0" * 5000 + "256.1.1.1") == [] and P.base_spans("00.000.0.255") == [("ip", 0, 12)]


def slow_choice(found, model, least):
    kept = [s[:3] for s in found if s[0] in P.BASE]
    for _, a, b, k in sorted((-model[p], a, b, k) for k, a, b, p in found if k not in P.BASE and model[p] >= least):
        if all(b <= x or y <= a for _, x, y in kept):
            kept.append((k, a, b))
    return sorted(kept, key=lambda s: (s[1], P.KINDS.index(s[0]), s[2]))


def test_spans_of_the_query_by_a_plain_loop(spark, small):
    """All spans, added ones included: candidates, counts, fit and choice without Spark."""
    more = [(10**9 + i, f"{w} ssn 123-4{i % 10}-678{i % 7} and call (030) 1234{i % 10}-5678, x{i} (at) mail (dot) org") for i, w in enumerate(["é", "social security", "order", "no."] * 9)]
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = {d: [(k, a, b, P.pattern(k, v)) for k, a, b, v in P.candidates(t)] for d, t in texts.items()}
    model = P.fit(Counter(p for c in found.values() for *_, p in c))
    got = {r.doc_id: r.spans for r in P.find(docs).collect()}
    assert got == {d: P.joined(slow_choice(c, model, P.LEAST)) for d, c in found.items()}
    assert any(s.split(":")[0] not in P.BASE for spans in got.values() for s in spans.split(",") if s)


def test_looks_tell_spans_of_equal_votes_apart():
    """Posteriors depend on votes; spans whose votes tie are weighed by their shape."""
    votes = (1, 0, 0, 0, 0, 1)
    counts = {}
    for shape, strict, n in ((3, 1, 900), (3, -1, 100), (7, 1, 100), (7, -1, 900)):
        counts[P.pattern("ssn", (strict, *votes[1:], 1, 2, 1, 1, 1, shape))] = n
    model = P.fit(counts)
    assert model[P.pattern("ssn", (*votes, 1, 2, 1, 1, 1, 3))] > model[P.pattern("ssn", (*votes, 1, 2, 1, 1, 1, 7))]
