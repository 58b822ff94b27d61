import hashlib
import random

import pandas as pd
import pytest
from lorebank.llm import exact_dedup


def plain(rows):
    """(doc_id, keep_id, group_size, sha) by definition, for rows of (doc_id, text)."""
    groups = {}
    for doc, text in rows:
        norm = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(hashlib.sha256(norm.encode()).hexdigest(), []).append((-len(text or ""), doc is None, doc or 0, doc))
    return sorted(((doc, min(g)[3], len(g), sha) for sha, g in groups.items() for *_, doc in g), key=str)


def cases():
    rng = random.Random(0)
    rows = [(k, rng.choice(["a b", "ab", " a\tb ", "", None, "\n", "c", "é x", "é x", f"t{k}"])) for k in range(200)]
    return [*rows, (None, "ab"), (7, "seven"), (7, "seven"), (None, "alone")]


@pytest.mark.parametrize("share", [exact_dedup.HEAVY_SHARE, 0.02, 0.5])
def test_groups_equal_the_definition(spark, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "HEAVY_SHARE", share)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in cases()], "doc_id long, text string, kept int, digest string").repartition(6)
    rows = exact_dedup.duplicate_groups(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == plain(cases())
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({r.text_sha256 for r in rows}) and all(r.doc_id == r.keep_id for r in kept)
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((r.doc_id for r in kept), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.duplicate_groups(docs).count() == 0 and exact_dedup.drop_duplicates(docs).count() == 0


def test_summary_is_bounded_and_keeps_heavy_digests(monkeypatch):
    monkeypatch.setattr(exact_dedup, "COUNTERS", 10)
    rng = random.Random(1)
    stream = [rng.choice(["hot", "warm", *(f"d{rng.randrange(5000)}" for _ in range(4))]) for _ in range(6000)]
    batches = (pd.DataFrame({"digest": stream[k : k + 500]}) for k in range(0, len(stream), 500))
    (out,) = exact_dedup.misra_gries(batches)
    counts = dict(zip(out.digest, out.n, strict=True))
    assert len(counts) <= 10
    for d in ("hot", "warm"):
        assert stream.count(d) - len(stream) / 11 <= counts[d] <= stream.count(d)
