import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from dyadlake.llm import packing as P

PATH = P.default_tokenizer()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_tokenizer(tokenizer):
    r = random.Random(3)
    signs = ["a", "B", "b", "é", "É", "İ", "ß", "×", "÷", "'s", "t", " ", "\n", "—", ".", "!", "1", "²", "é", "中", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "😀", " ", "\x1c", " "]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    e = P.Encoder(PATH)
    for i in range(0, len(texts), 50):
        ids, begins = e.encode(texts[i : i + 50])
        for k, t in enumerate(texts[i : i + 50]):
            assert ids[begins[k] : begins[k + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1], t


@pytest.mark.parametrize("seed", range(6))
def test_differencing_places_every_item_once_and_evenly(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 500) for _ in range(r.choice([1, 7, 60, 400]))]
    for k in (1, 2, 5, 31):
        bins = P.difference(sizes, k)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and len(bins) <= k
        if len(sizes) >= 60 and k <= 5:
            loads = [sum(sizes[i] for i in b) for b in bins]
            assert max(loads) - min(loads) <= max(sizes) // 4


def test_known_differencing():
    loads = sorted(sum([8, 7, 6, 5, 4][i] for i in b) for b in P.difference([8, 7, 6, 5, 4], 2))
    assert loads == [14, 16]  # the textbook result of differencing
    assert P.difference([], 3) == [] and P.windows([], 10) == []


def test_count_rises_with_capacity():
    bins = P.windows([6, 6, 6, 6], 10)
    assert len(bins) == 4 and max(len(b) for b in bins) == 1


def check(rows, texts, tokenizer, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for d, own in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            if "ids" in r.asDict():
                assert r.ids == ids[at : at + r.length].tolist()
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sum(window - sum(r.length for r in own) for own in by_seq.values())


def test_pieces_tile_documents_and_windows(spark, tokenizer):
    r = random.Random(5)
    texts = [None, "", "a", "word " * 5000, *[" ".join(r.choice(["the", "king", "Été", "x1,"]) for _ in range(r.choice([0, 3, 50, 700]))) for _ in range(80)]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, extra int").repartition(3)
    rows = P.pack(df, PATH, block=5000).collect()
    padding = check(rows, texts, tokenizer, 2048)
    assert padding < 2048 * 9  # at most a window for each small block
    ids = P.pack(df, PATH, window=64, with_ids=True)
    check(ids.collect(), texts, tokenizer, 64)
    for s in P.sequences(ids).limit(5).collect():
        assert 0 < len(s.ids) <= 64


def test_little_padding(spark, small):
    from pyspark.sql import functions as F

    rows = P.pack(spark.read.parquet(f"{small}/documents.parquet"), PATH).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.avg(1 - F.col("n") / 2048)).first()
    assert rows[0] < 0.02


def test_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (None, "x")], "doc_id long, text string")
    assert P.pack(df, PATH).count() >= 3 and P.pack(df.limit(0), PATH).count() == 0


def test_columns_that_clash(spark):
    rows = [(1, "some words here", "a", 7, "b"), (2, None, None, 8, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text string, START int, whole_text string")
    plain = sorted(tuple(r) for r in P.pack(df, P.default_tokenizer()).drop("sequence_id", "offset").collect())
    for with_ids in (False, True):
        out = P.pack(df, P.default_tokenizer(), keep=df.columns, with_ids=with_ids)
        assert out.columns[:4] == ["doc_id", "text", "__text", "whole_text"] and [c.lower() for c in out.columns].count("start") == 1
        assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out.collect()) == plain
        assert {(r.doc_id, r["__text"], r.whole_text) for r in out.collect()} == {(1, "a", "b"), (2, None, "c")}
