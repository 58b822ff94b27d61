"""Operators give every row, also where a group is large."""

import random

import pytest
from lorebank.operators import entities, extraction, pairs


def test_entity_links_hold_every_pair(spark):
    members = {1: range(40), 2: range(30, 45), 3: [99]}
    links = spark.createDataFrame([(e, m, 0.5 + m % 5 / 10) for e, own in members.items() for m in own] + [(1, 3, 0.9)], "entity_id long, memory_id long, confidence double")
    edges = spark.createDataFrame([(38, 36), (0, 39)], "source long, target long")
    want = {(a, b) for own in members.values() for a in own for b in own if a < b} - {(36, 38), (0, 39)}
    got = [(r.a, r.b) for r in entities.shared_entity_pairs(links, edges).collect()]
    assert len(got) == len(want) and set(got) == want


def test_category_edges_hold_every_pair(spark):
    rows = spark.createDataFrame([(k, "Tool, big one" if k % 2 else "tool") for k in range(50)] + [(77, None)], "entity_id long, category string")
    got = [(r.source, r.target, r.label) for r in extraction.category_edges(rows).collect()]
    want = {(a, b, "same_category:tool") for a in range(50) for b in range(a + 1, 50)}
    want |= {(a, b, "same_category:big_one") for a in range(1, 50, 2) for b in range(a + 2, 50, 2)}
    assert len(got) == len(want) and set(got) == want


def test_mean_similarity_of_a_chain_covers_all_pairs(spark):
    rows = [(1, [1.0, 0.0], "a b  c d e f"), (2, [3.0, 3.0], "x"), (3, [0.0, 1.0], "y"), (4, [0.0, 0.0], None), (5, [1.0], "z")]
    rows = spark.createDataFrame(rows, "id long, embedding array<double>, content string")
    links = pairs.similar_pairs(rows, 0.5)
    (r,) = pairs.cluster_candidates(pairs.components(links), rows).collect()
    assert (r.root, r.size, r.topic) == (1, 3, "a b c d e") and abs(r.avg_similarity - 2**0.5 / 3) < 1e-12  # below the threshold
    (r,) = pairs.cluster_candidates(rows.selectExpr("id", "1L AS root"), rows).collect()
    assert r.size == 5 and abs(r.avg_similarity - 2**0.5 / 10) < 1e-12


@pytest.mark.parametrize("sources, made, asked", [(1024, 8_000_000, 300_000), (3, 40, 300_000), (3, 40, 0)])
def test_mentions_hold_every_pair_once_and_compare_none(spark, monkeypatch, sources, made, asked):
    monkeypatch.setattr(extraction, "MENTION_SOURCES", sources)
    monkeypatch.setattr(extraction, "MENTION_PAIRS", made)
    monkeypatch.setattr(extraction, "MENTION_WORDS", asked)
    rng = random.Random(4)
    texts = [(k, " ".join(rng.choices(["the", "The", "the", "of", "a", "b", "c", "d"], k=rng.choice([0, 1, 3, 9])))) for k in range(60)]
    texts += [(7, "the d x"), (60, None)]
    facts = [(k, t.split()[0] if t.split() else None) for k, t in texts[:60]] + [(61, "nowhere")]
    two = [(3, "of"), (3, "The"), (3, "the"), (62, "x"), (62, "d"), (62, "a")]
    rows = spark.createDataFrame(texts, "id long, content string")
    for own in (facts, facts + two):
        df = extraction.mention_edges(spark.createDataFrame(own, "id long, subject string"), rows, 0)
        got = [(r.source, r.target) for r in df.collect()]
        want = {(s, t) for s, w in own for t, text in texts if w and text and s != t and w.lower() in text.lower().split()}
        assert len(got) == len(want) and set(got) == want
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert own is not facts or "Aggregate" not in plan[: plan.index("Join")]
