"""What the language stage rejects."""

import random

import corpus_pipeline
from lorebank.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, parts, n):
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def test_only_plainly_foreign_texts_go(spark):
    rng = random.Random(1)
    kinds = {"aa": ["ba", "ko", "ri", "te"], "bb": ["sch", "ung", "ein", "ver"]}
    rows = [(words(rng, kinds[lang], 200), lang) for lang in kinds for _ in range(40)]
    clean = len(rows)
    mixed = words(rng, kinds["aa"], 90) + " " + words(rng, kinds["bb"], 20)
    rows += [(mixed, "aa"), ("Re.", "bb"), (words(rng, kinds["aa"], 200), None), (words(rng, kinds["aa"], 100), "other label")]
    kept = len(rows)
    rows += [(words(rng, kinds["aa"], 200), "bb"), ("日本語の文章です。これは学習していません。" * 30, None), (None, "aa"), ("", "aa"), ("12 34 !?", "aa")]
    docs = spark.createDataFrame([(k, t, x, "s", len(t or "")) for k, (t, x) in enumerate(rows)], SCHEMA)
    learned = docs.where("doc_id < 80")
    model = language.train(learned)
    found = language.identify(docs, model, "found", stated_col="lang")
    gone = sorted(r.doc_id for r in found.where(language.rejected("found", found["text"])).collect())
    assert gone == list(range(kept, len(rows))) and clean == 80
    out = corpus_pipeline.language_id(spark, docs.where(f"doc_id <> {kept}"), "")  # it learns from all labelled rows
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == list(range(kept))


def test_many_languages_keep_the_model_in_proportion_to_its_sample():
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x100, 0x500)]
    samples = {f"l{k:03}": [words(rng, rng.sample(letters, 12), 100)] for k in range(60)}
    model = language.Model(samples)
    sampled = sum(len(t.encode()) for texts in samples.values() for t in texts)
    assert model.size() < 400 * sampled and len(model.languages) == 60
    probe = [samples["l007"][0], samples["l042"][0]]
    assert model.predict(probe)[0] == ["l007", "l042"] and model.code_lengths(probe).shape == (2, 60)


def test_the_sample_is_bounded_in_bytes_and_languages(spark, monkeypatch):
    docs = spark.createDataFrame([(f"{lang} {k} " * 20, lang) for lang in "abcd" for k in range(20 - ord(lang) % 5)], "text string, lang string")
    monkeypatch.setattr(language, "MODEL_BYTES", 2000)
    sample = language.training_sample(docs)
    assert set(sample) == set("abcd") and all(1 <= len(t) and sum(map(len, t)) <= 500 for t in sample.values())
    monkeypatch.setattr(language, "MODEL_BYTES", 1)
    assert {len(t) for t in language.training_sample(docs).values()} == {1}
    monkeypatch.setattr(language, "LANGUAGES", 2)
    assert len(language.training_sample(docs)) == 2
