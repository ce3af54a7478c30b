from collections import Counter

import numpy as np
import pytest
from dyadlake.llm import langid as L
from pyspark.sql import functions as F

ROWS = [(i, t, g) for i, (t, g) in enumerate([("the house of the king", "en"), ("la casa del rey", "es"), ("the end of the day", "en"), ("el fin de la noche", "es"), ("over the hill", "en"), ("por la calle", "es"), (None, "en"), ("", "es"), ("   123 !!", "en"), ("unlabelled text", None)])]


def brute_grams(text):
    """Padded words' 1- to 3-grams."""
    code = "".join(c if c.isalpha() else " " for c in text.lower())
    out = []
    words = code.split()
    for k, w in enumerate(words):
        ends = k < len(words) - 1 or code.endswith(" ")
        p = " " + w + (" " if ends else "")
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                g = p[i : i + n]
                if g.strip() and (n == 1 or True) and not (n == 3 and " " in g[1]):
                    out.append(g)
    return out


@pytest.mark.parametrize("texts", [["ab cd", "é!", "", "x"], ["a", "b"], ["...a", "b..."], ["", "", "zz zz"]])
def test_gram_counts_match_brute_force(texts):
    bucket, whose, letters = L.grams(texts)
    for i, t in enumerate(texts):
        assert (whose == i).sum() == len(brute_grams(t))
        assert letters[i] == sum(c.isalpha() for c in t)
        alone = np.sort(L.grams([t])[0])
        assert np.array_equal(np.sort(bucket[whose == i]), alone)  # neighbours don't matter


def test_edges_and_defined_results(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumn("LANG_PRED", F.lit("old")).withColumn("Score", F.lit(9))
    model = L.train(docs.where("doc_id % 2 = 0 or doc_id % 3 = 0"))
    got = {r.doc_id: r for r in L.predict(docs, model).collect()}
    assert len(got) == 10 and got[6].lang_pred == got[7].lang_pred == got[8].lang_pred == "und" and got[8].score == 0.0
    assert got[4].lang_pred == "en" and 0 <= got[4].score <= 1
    assert [c for c in L.predict(docs, model).columns if c.lower() in ("lang_pred", "score")] == ["lang_pred", "score"]
    assert L.accepted(docs, model).columns == docs.columns
    assert {r.doc_id for r in L.accepted(docs, model, 0.0).collect()} == {0, 1, 2, 3, 4, 5, 9}


def test_empty_tables_and_no_labels(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    model = L.train(docs.limit(0))
    assert {r.lang_pred for r in L.predict(docs, model).collect()} == {"und"}
    assert L.predict(docs.limit(0), L.train(docs)).count() == 0


def test_repeated_and_long_texts_agree(spark):
    docs = spark.createDataFrame([(1, "the king " * 300_000), (2, "the king"), (2, "the king")], "doc_id long, text string")
    model = L.train(spark.createDataFrame(ROWS, "doc_id long, text string, lang string"))
    assert Counter(r.lang_pred for r in L.predict(docs, model).collect()) == {"en": 3}


def test_held_out_accuracy(spark, small):
    from dyadlake.llm import queries

    out = queries.op9_language_id(spark, small).join(spark.read.parquet(f"{small}/documents.parquet"), "doc_id")
    row = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert row[0] >= 0.97 and row[1] > 20


def test_long_texts_are_cut_without_losing_grams(monkeypatch):
    text = " ".join(["Straße", "été", "1st", "w" * 30, "..."] * 40)
    whole = np.sort(L.grams([text])[0])
    monkeypatch.setattr(L.S, "CHUNK", 70)
    parts, owner = L.segments(["", text, None])
    assert "".join(parts) == text and owner[0] == 0 and owner[-1] == 2 and max(map(len, parts)) <= 70
    long = "a" * 500 + " " + "b" * 90 + "c d" + "e" * 71
    runs, _ = L.segments([long])
    assert "".join(runs) == long and len(runs) > 1
    assert np.array_equal(np.sort(np.concatenate([L.grams([p])[0] for p in runs])), np.sort(L.grams([long])[0]))
    assert np.array_equal(np.sort(np.concatenate([L.grams([p])[0] for p in parts])), whole)


def slow_bayes(rows, texts):
    """Predictions from counts in dictionaries."""
    counts, docs = {}, Counter()
    for t, g in rows:
        if t is not None and g is not None:
            docs[g] += 1
            counts.setdefault(g, Counter()).update(L.grams([t])[0].tolist())
    out = []
    for t in texts:
        if not any(c.isalpha() for c in t or ""):
            out.append((L.UNKNOWN, 0.0))
            continue
        joint = {g: np.log(docs[g] / sum(docs.values())) + sum(np.log((c[k] + 0.1) / (sum(c.values()) + 0.1 * L.BUCKETS)) for k in L.grams([t])[0].tolist()) for g, c in counts.items()}
        best = min(joint, key=lambda g: (-joint[g], g))
        out.append((best, 1 / sum(np.exp(v - joint[best]) for v in joint.values())))
    return out


@pytest.mark.parametrize("group", [256, 1, 2])
def test_predictions_by_a_plain_loop(spark, group):
    """In one table, and in several groups of languages."""
    rows = [(t, g) for _, t, g in ROWS] + [("der Hund und die Katze", "de"), ("le chat et le chien", "fr"), ("il gatto e il cane", "it")] * 2
    docs = spark.createDataFrame([(i, t, g, "x") for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, whole_text string")
    got = {r.doc_id: r for r in L.predict(docs, L.train(docs, group=group)).collect()}
    for i, (lang, p) in enumerate(slow_bayes(rows, [t for t, _ in rows])):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(p, abs=1e-3) and got[i].whole_text == "x"


def test_more_languages_than_a_table_or_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD", 5)
    n = 40
    name = lambda i: chr(97 + i % 26) * 3 + chr(97 + i // 26) * 3
    docs = spark.createDataFrame([(i, f"{name(i)} {name(i)}", f"l{i:03}") for i in range(n)], "doc_id long, text string, lang string")
    model = L.train(docs, group=7)
    assert model.langs == sorted(f"l{i:03}" for i in range(n))
    assert all(r.lang_pred == f"l{r.doc_id:03}" for r in L.predict(docs, model).collect())
    assert L.accepted(docs, model).columns == docs.columns and L.accepted(docs, model).count() == n
