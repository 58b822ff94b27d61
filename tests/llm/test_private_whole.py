"""Disclosing words are found and marked over whole texts, whatever the number of candidates."""

import pytest
from lorebank.llm import private

FAR = " ".join(["common words here about mail"] * 20)  # far more than any window
TEXTS = [f"quibnox {FAR} anna@x.org {FAR} v{k} quibnox" for k in "abc"] + [f"{FAR} {k}" for k in range(200)] + [None, ""]


def marked(docs, texts):
    return {r.doc_id: [texts[r.doc_id][t.start : t.end] for t in r.terms] for r in private.find_private(docs).collect() if r.terms}


@pytest.mark.parametrize("most", [private.BROADCAST_TERMS, 0])
def test_words_far_from_a_value_are_marked_everywhere(spark, monkeypatch, most):
    monkeypatch.setattr(private, "BROADCAST_TERMS", most)
    texts = [*TEXTS, "bob quibnox alone"]  # without the value: n(t) = 4, disclosure 1 - log(4/3) / log(N/3) > 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert marked(docs, texts) == {0: ["quibnox"] * 2, 1: ["quibnox"] * 2, 2: ["quibnox"] * 2, len(TEXTS): ["quibnox"]}
    clean = {r.doc_id: r.text or "" for r in private.sanitise(docs).collect()}
    assert not any("quibnox" in t for t in clean.values()) and clean[10] == texts[10]


def test_both_ways_of_counting_split_words_alike(spark, monkeypatch):
    texts = ["abc² xyzⅷ 二〇二四年 foo_bar1 ÄÖÜ", "abc xyz 二四年 İstanbul Straße", "ABC² abc²"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = spark.createDataFrame([(w,) for w in sorted({w for t in texts for w in private.words_of(t)})], "term string")
    some = {r.term: r.n for r in private.document_frequency(docs, terms).collect()}
    assert some["abc²"] == 2 and some["abc"] == 1 and set(some.values()) == {1, 2}
    monkeypatch.setattr(private, "BROADCAST_TERMS", 1)
    assert {r.term: r.n for r in private.document_frequency(docs, terms).collect()} == some
