"""Forms that scale give what the plain ones give."""

import numpy as np
import pytest
from lorebank.operators import entities, extraction, graph, lifecycle, pairs


@pytest.mark.parametrize("rows, pivot_rows, least", [(300, 50_000, 256), (300, 20, 16), (300, 300, 7)])
def test_blocks_by_direction_lose_no_pair(spark, monkeypatch, rows, pivot_rows, least):
    monkeypatch.setattr(pairs, "PIVOT_ROWS", pivot_rows)
    monkeypatch.setattr(pairs, "BLOCK_ROWS", least)
    monkeypatch.setattr(pairs, "TILE", (16, 32))
    rng = np.random.default_rng(rows + least)
    centres = rng.normal(size=(6, 8))
    vectors = [(centres[k % 6] + 0.2 * rng.normal(size=8)).tolist() for k in range(rows)] + [[0.0] * 8, [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<float>")
    unit = [np.float32(v).astype(float) / (np.linalg.norm(np.float32(v)) or 1) for v in vectors]
    for threshold in (0.97, 0.5, -0.5):
        want = {(a, b): float(unit[a] @ unit[b]) for a in range(len(unit)) for b in range(a + 1, len(unit)) if len(unit[a]) == len(unit[b]) and unit[a].any() and unit[b].any()}
        want = {k: s for k, s in want.items() if s > threshold}
        got = [(r.a, r.b, r.similarity) for r in pairs.similar_pairs(df, threshold).collect()]
        assert len(got) == len(want) and all(abs(want[a, b] - s) < 1e-6 for a, b, s in got)
    some = {(r.a, r.b) for r in pairs.pairs_between(df.where("id < 50"), df, 0.9).collect()}
    assert some == {(a, b) for a in range(50) for b in range(len(unit)) if a != b and len(unit[a]) == len(unit[b]) and unit[b].any() and unit[a] @ unit[b] > 0.9}


def test_distant_groups_never_meet(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PIVOT_ROWS", 10)
    rng = np.random.default_rng(1)
    own = spark.createDataFrame([(k, (np.eye(4)[k % 4] + 0.01 * rng.normal(size=4)).tolist()) for k in range(80)], "id long, v array<double>")
    _, gap = pairs.grouped_by_direction(own, 80)
    assert (gap[:-1, :-1] > 1.0).any() and (np.diag(gap) == 0).all()


def test_classes_say_all_pairs(spark):
    members = {1: range(40), 2: range(30, 45), 3: [99]}
    links = spark.createDataFrame([(e, m, 0.5) for e, own in members.items() for m in own] + [(1, 3, 0.9)], "entity_id long, memory_id long, confidence double")
    edges = spark.createDataFrame([(38, 36), (0, 39), (36, 38), (7, 7), (1, 99)], "source long, target long")
    pair = {(r.a, r.b) for r in entities.shared_entity_pairs(links, edges).collect()}
    for r in entities.shared_entity_classes(links, edges).collect():
        own = set(members[r.entity_id])
        assert r.representative == min(own)
        assert r.new_links == sum((min(r.memory_id, m), max(r.memory_id, m)) in pair for m in own - {r.memory_id})
    rows = spark.createDataFrame([(k, "Tool, big one" if k % 2 else "tool") for k in range(50)] + [(77, None)], "entity_id long, category string")
    classes = {(r.entity_id, r.label): (r.representative, r.links) for r in extraction.category_classes(rows).collect()}
    assert classes == {(k, "same_category:tool"): (0, 49) for k in range(50)} | {(k, "same_category:big_one"): (1, 24) for k in range(1, 50, 2)}


def test_paths_have_no_longest_length(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(0, 50), (50, 2)], "source long, target long")
    assert graph.shortest_path(chain, 0, 30) == list(range(31))
    assert graph.shortest_path(chain, 30, 0) is None and graph.shortest_path(chain, 5, 5) == [5]
    found = {r.id: r.depth for r in graph.bfs(chain, spark.createDataFrame([(0,)], "id long"), 100).collect()}
    assert found == {k: k for k in range(41)} | {50: 1}


def test_many_searches_equal_single_ones(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 9)
    monkeypatch.setattr(pairs, "TILE", (4, 8))
    rng = np.random.default_rng(3)
    vectors = [rng.integers(-2, 3, 3).astype(float).tolist() for _ in range(120)] + [[1.0, 0.0], [0.0, 0.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<double>")
    got = {}
    for r in pairs.nearest(df, df.where("id % 7 = 0 or id >= 120"), 5).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r.id, round(r.score, 9)))
    for q in [*range(0, 120, 7), 120]:
        unit = lambda v: np.array(v) / np.linalg.norm(v)
        if not any(vectors[q]):
            continue
        fits = [(-round(float(unit(v) @ unit(vectors[q])), 9), k) for k, v in enumerate(vectors) if len(v) == len(vectors[q]) and any(v)]
        assert [round(s, 6) for _, s in got[q]] == [round(-s, 6) for s, _ in sorted(fits)[:5]]
    assert 121 not in got and len(got[120]) == 1


def test_empty_tables_have_no_pairs_and_no_neighbours(spark):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [])], "id long, embedding array<float>")
    assert pairs.similar_pairs(none, 0.5).count() == 0 and pairs.similar_pairs(one, 0.5).count() == 0
    assert pairs.pairs_between(none, one, 0.5).count() == 0 and pairs.nearest(none, one, 3).count() == 0
    assert [tuple(r) for r in pairs.nearest(one, one, 3).collect()] == [(1, 1, 1.0, 0)]
    assert pairs.nearest(one, none, 3).count() == 0
    links = spark.createDataFrame([], "entity_id long, memory_id long, confidence double")
    edges = spark.createDataFrame([], "source long, target long")
    assert entities.shared_entity_classes(links, edges).count() == 0
    assert graph.detect_cycles(edges.selectExpr("source", "target", "'x' AS edge_type")).count() == 0


def test_cycles_behind_tails_are_found(spark):
    edges = spark.createDataFrame([(k, k + 1, "x") for k in range(8)] + [(8, 6, "x"), (3, 20, "x"), (30, 31, "x"), (9, 9, "x")], "source long, target long, edge_type string")
    assert sorted(r.cycle for r in graph.detect_cycles(edges).collect()) == [[6, 7, 8], [9]]


def test_inference_of_blocks_equals_that_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 7)
    monkeypatch.setattr(pairs, "TILE", (4, 8))
    monkeypatch.setattr(pairs, "SENT_ROWS", 5)
    rng = np.random.default_rng(8)
    kinds, some = ("Correction", "Semantic"), rng.normal(size=(12, 3)).tolist()
    own = [(k, some[k % 12] if k % 4 else rng.normal(size=3).tolist(), kinds[k % 2], None if k % 9 == 0 else k % 3, None if k % 7 == 0 else f"t{k % 5}", k * 37 % 50, k % 10 / 10) for k in range(60)]
    own += [(60, [0.0] * 3, "Correction", 1, "x", 1, 0.5), (61, [1.0], "Correction", 1, "x", 1, 0.5), (62, None, "Correction", 1, "x", 1, 0.5)]
    rows = spark.createDataFrame(own, "id long, embedding array<float>, memory_type string, agent_id long, content string, created_at_us long, confidence double")
    new, bounds = rows.where("id % 3 = 0 or id > 58"), (0.9, 0.7, 0.4, 0.5)
    listed = lambda df: sorted((r.action, r.source, r.target, round(r.weight, 9)) for r in df.collect())
    got = listed(lifecycle.write_inference_between(new, rows, 0.2, *bounds))
    assert got == listed(lifecycle.write_inference(lifecycle.new_against_existing(new, rows, 0.2), rows, *bounds))
    assert {x[0] for x in got} == {"contradicts", "mark_obsolete", "invalidate", "related", "supersedes", "lower_confidence"}


def test_inference_shuffles_no_text_and_no_pair(spark, sf):
    from lorebank.plans.catalog import QUERIES

    plan = QUERIES["write_inference_actions"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "FlatMapGroups" in plan
    above = plan[: plan.index("FlatMapGroups")]
    assert "Join" not in above and "Window" not in above
