import math
import random

import numpy as np
from lorebank.llm import language

TEXTS = {"aa": ["abab abba baba", "ab ba ab"], "cc": ["cdcd dccd ccdd é", "dc cd dc"]}


def slow_bits(texts, text, order):
    counts = {}
    for t in texts:
        b = b"\n" * order + t.encode()
        for i in range(order, len(b)):
            for k in range(order + 1):
                own = counts.setdefault(b[i - k : i], {})
                own[b[i]] = own.get(b[i], 0) + 1
    b, bits = b"\n" * order + text.encode(), 0.0
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            own = counts.get(b[i - k : i])
            if not own:
                continue
            total, kinds = sum(own.values()), len(own)
            if b[i] in own:
                bits -= math.log2(own[b[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_the_definition():
    rng = random.Random(0)
    probes = ["", "abba", "cdcd é", "zzz", "ab cd zq é漢", *("".join(rng.choices("abcd z\né", k=40)) for _ in range(20))]
    for order in (1, 2, 4):
        model = language.Model(TEXTS, order)
        want = [[slow_bits(TEXTS[x], p, order) for x in model.languages] for p in probes]
        assert np.allclose(model.code_lengths(probes), want, rtol=1e-4, atol=1e-3)


def test_long_texts_are_scored_whole(monkeypatch):
    model, text = language.Model(TEXTS, 3), "abba cdc " * 500
    whole = model.code_lengths([text, "ab"])
    monkeypatch.setattr(language, "PIECE", 100)
    assert np.allclose(model.code_lengths([text, "ab"]), whole, rtol=1e-5)


def test_hash_index_finds_what_is_there():
    codes = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 5000).astype(np.uint64))
    index = language.HashIndex(codes)
    assert (index.find(codes) == np.arange(len(codes))).all()
    assert (index.find(codes + np.uint64(1 << 50)) == -1).all()


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2
    model = language.train(docs.where(~held))
    rows = language.identify(docs.where(held), model).select("lang", "language.*").collect()
    assert len(rows) > 200 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_DOCS", 5)
    docs = spark.createDataFrame([(f"{lang} text {k % 40}", lang) for lang in "abcd" for k in range(60)] + [("x" * 70_000, "a")], "text string, lang string")
    sample = language.training_sample(docs)
    assert {lang: len(set(t)) for lang, t in sample.items()} == dict.fromkeys("abcd", 5) and all(len(t) == 5 for t in sample.values())
    monkeypatch.setattr(language, "SAMPLE_TOTAL", 8)
    assert {lang: len(t) for lang, t in language.training_sample(docs).items()} == dict.fromkeys("abcd", 2)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "aa", 1), ("", "aa", 1), ("123 !?", None, 1), ("abab", "aa", 1), ("abab", "aa", 1), ("cdcd", None, 1), ("cd dc", "cc", 1)], "text string, lang string, lang_pred int")
    model = language.train(docs)
    rows = language.identify(docs, model).select("text", "language.*").collect()
    assert {(r.text, r.lang_pred) for r in rows} == {(None, "und"), ("", "und"), ("123 !?", "und"), ("abab", "aa"), ("cdcd", "cc"), ("cd dc", "cc")}
    assert language.identify(docs, language.train(docs.limit(0))).select("language.lang_pred").distinct().collect()[0][0] == "und"
    assert language.identify(docs.limit(0), model).count() == 0
