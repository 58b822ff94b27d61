import hashlib
import random
import re

from lorebank.llm import private

RULES = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 12 <= sum(c.isdigit() for c in s) <= 19 and slow_luhn([int(c) for c in s if c.isdigit()])),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= sum(c.isdigit() for c in s) <= 15),
}


def slow_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    spans = [(m.start(), k, m.end()) for k, (pattern, test) in enumerate(RULES.values()) for m in pattern.finditer(text) if test(m[0])]
    return sorted(spans)


def test_pattern_spans_equal_the_rules():
    rng = random.Random(2)
    parts = ["a@b.c", "@", "x@y.z@q.r", ".", "-", "1.2.3.4", "256.1.1.1", "00010.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", " ", "é", "5", "12", "+49 30 123456789012345", "a_b%@x-y.z-.q", "\n", "..", "@a", "b@c"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert private.base_spans(text) == plain(text), text
    assert private.base_spans("a" * 100_000 + "@b.c" + "." * 1000) == [(0, 0, 100_004)]
    assert private.base_spans("1" * 100_000) == plain("1" * 1000) == []


def test_reported_counts_and_digests_equal_the_rules(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, "+1 (017) 555-7713, 1.2.3.4 a@b.c d@e.f 4111 1111 1111 1111 x 9.9.9.9 y 8.8.8.8"), (-2, None)], "doc_id long, text string")
    docs = docs.unionByName(extra)
    rows = private.span_report(private.find_private(docs)).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == len(texts)
    names = list(RULES)
    for r in rows:
        spans = plain(texts[r.doc_id])
        assert [r[f"n_{name}"] for name in names] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        told = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == [s for s in told.split(",") if s]


def test_texts_with_very_many_values():
    text = "word a@b.c other 1.2.3.4 " * 20_000
    spans = private.base_spans(text)
    assert len(spans) == 40_000
    found = private.near_terms(text, spans)
    assert set(found) == {("email:a@b.c", t) for t in ("", "word", "other")} | {("ip:1.2.3.4", t) for t in ("", "word", "other")}


def test_words_that_reveal_a_value_are_found(spark):
    secret = "zorblax met me at mail anna@x.org today about zorblax"
    texts = [f"{secret} v{k} common words here" for k in "abc"] + [f"common words here today mail about met {k}" for k in range(60)] + ["today mail bob@y.org about met"] * 3 + [None, ""]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, base int").repartition(4)
    found = private.find_private(docs).collect()
    flagged = {r.doc_id: {texts[r.doc_id][t.start : t.end] for t in r.terms} for r in found if r.terms}
    assert flagged == {k: {"zorblax"} for k in range(3)}
    rows = {r.doc_id: r for r in private.span_report(private.find_private(docs)).collect()}
    assert rows[0].n_email == 1 and "0:7" in rows[0].spans and rows[0].spans.startswith("term:0:7,email:")
    start = texts[0].index("anna")
    assert rows[0].base_sha256 == hashlib.sha256(f"email:{start}:{start + 10}".encode()).hexdigest()
    assert rows[63 + 3].spans == "" and rows[66].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in private.sanitise(docs).collect()}
    assert "zorblax" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == texts[10] and clean[66] is None


def test_large_candidate_sets_are_counted_by_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"Foo bar bar {'baz' * (k % 2)}") for k in range(10)], "doc_id long, text string")
    terms = spark.createDataFrame([("foo",), ("baz",), ("none",)], "term string")
    some = {r.term: r.n for r in private.document_frequency(docs, terms).collect()}
    monkeypatch.setattr(private, "BROADCAST_TERMS", 1)
    assert {r.term: r.n for r in private.document_frequency(docs, terms).collect()} == some == {"foo": 10, "baz": 5}


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c")], "doc_id long, text string")
    assert [r.n_email for r in private.span_report(private.find_private(docs)).collect()] == [1, 1, 1]
    assert private.find_private(docs.limit(0)).count() == 0 and private.sanitise(docs.limit(0)).count() == 0
