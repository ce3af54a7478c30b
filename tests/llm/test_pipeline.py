"""The pipeline's stages against brute force over a small corpus with planted cases."""

import random

import corpus_pipeline as C
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    r = random.Random(4)
    en = ["the", "house", "of", "king", "and", "with", "their", "water", "through", "night", "light", "which", "were", "there"]
    de = ["der", "und", "nicht", "schön", "über", "mit", "wasser", "zwischen", "straße", "licht", "welche", "waren", "dort", "auch"]
    text = lambda w, n: " ".join(r.choice(w) + str(r.randrange(50)) * (r.random() < 0.02) for _ in range(n))
    clean = {i: text(en if i % 2 else de, 80) for i in range(40)}
    docs = dict(clean)
    docs[100], docs[101] = clean[1], clean[2] + " ende"  # an exact and a near copy
    docs[102] = None
    docs[103] = "12345 !!! ---"
    bench = text(en, 15)
    docs[104] = text(en, 40) + " " + bench.upper() + " " + text(en, 40)
    docs[105] = text(en, 60) + " mail me at jo.doe@mail.example.com or +1 (614) 555-8001 now"
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(d, t, "de" if d in clean and d % 2 == 0 else "en", "s", len(t or "")) for d, t in docs.items()]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs


def test_stages(spark, planted):
    path, docs = planted
    assert len(C.STAGES) == 5 and C.ORACLE_SQL is None
    frame = spark.read.parquet(f"{path}/documents.parquet")
    kept = set(docs)
    for (name, stage), gone in zip(C.STAGES[:4], [{102, 103}, {100, 101}, {104}, set()], strict=True):
        out = stage(spark, frame, path)
        assert out.schema.simpleString() == frame.schema.simpleString(), name
        kept -= gone
        rows = {r.doc_id: r.text for r in out.collect()}
        assert set(rows) == kept, name
        assert {d: t for d, t in rows.items() if d != 105} == {d: docs[d] for d in kept if d != 105}, name
        frame = out
    assert rows[105].endswith("mail me at <EMAIL> or <PHONE> now")
    pieces = C.packed(spark, frame, path).collect()
    assert {r.doc_id for r in pieces} == kept


def test_run_equals_the_stages_and_tiles_every_document(spark, planted):
    path, docs = planted
    rows = C.run(spark, path).collect()
    assert {r.doc_id for r in rows} == set(docs) - {100, 101, 102, 103, 104}
    for d in {r.doc_id for r in rows}:
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and own[-1].start + own[-1].length == own[0].doc_tokens


def test_empty_table(spark, planted, tmp_path):
    path, _ = planted
    frame = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        out = stage(spark, frame, path)
        assert out.count() == 0
        frame = out if "text" in out.columns else frame


def test_extra_columns_stay(spark, planted):
    from pyspark.sql import functions as F

    path, _ = planted
    frame = spark.read.parquet(f"{path}/documents.parquet").withColumns({"score": F.lit(1), "KEEP": F.lit("k"), "component_id": F.lit(2)})
    for _, stage in C.STAGES[:4]:
        frame = stage(spark, frame, path)
        assert frame.columns[-3:] == ["score", "KEEP", "component_id"] and frame.count() > 0
